"""Operators of a training-data pipeline: near copies, packing, language, licences, fingerprints, personal data,
code search, line copies, source mixing and web archive derivatives.  Nothing else in the package imports this folder."""
