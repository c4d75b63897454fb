"""One query per operator over the whole of its table, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import cws, dialogues, hamming, langid, licenses, lines, minhash, mixing, packing, pii, spelling, tokenfiles, warc
from corpusloom.llm.work import documents
from corpusloom.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


_NEAR_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) as y from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) as kept
from documents d left join sizes using (doc_id) left join least on least.x = d.doc_id
"""


@query(_NEAR_SQL)
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder), percent=85)


_LINES_SQL = """
with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (
  select doc_id, generate_subscripts(l, 1) as i, unnest(l) as line from parts),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
firsts as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (first < doc_id))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (first is null or first >= doc_id), '')) as kept_sha256
from keyed left join firsts using (key) group by doc_id
"""


@query(_LINES_SQL)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.curriculum(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with a digest in place of their ids."""
    import public_tokenizers

    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query()
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(documents(spark, folder))


@query()
def op3_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(documents(spark, folder)).select("doc_id", "held_out", "lang_pred", "score", "shares")


@query()
def op5_weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return cws.fingerprints(documents(spark, folder))


@query()
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder)).drop("base")


_CODES_SQL = """
with q as (select * from embeddings where vec_id % 20 = 0),
pairs as (
  select q.vec_id as query_id, e.vec_id as id,
    list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: case when (p[1] > 0) <> (p[2] > 0) then 1 else 0 end)) as d
  from q join embeddings e on e.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by d, id)::int as rank, id, d::int as distance
from pairs qualify row_number() over (partition by query_id order by d, id) <= 10
"""


@query(_CODES_SQL)
def op7_hamming_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 20, among all vectors."""
    codes = hamming.codes(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding")
    return hamming.nearest(codes, codes.filter("id % 20 = 0"), k=10)


@query()
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(documents(spark, folder))


@query()
def op10_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of all pages, written in full."""
    return warc.derive(warc.responses_of_pages(spark.read.parquet(f"{folder}/pages.parquet")))


@query()
def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as token ids in files, read back from them."""
    import public_tokenizers

    path = work_path(spark, "token-files")
    tokenfiles.write_tokens(documents(spark, folder), path, public_tokenizers.path("word_bpe_49k.json"), width=2)
    rows = tokenfiles.read_tokens(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _crc32_sql(numbers: str) -> str:
    """The crc32 of a list of byte values; the table of 256 values is one row called ``crc``."""
    return f"""xor(list_reduce(list_concat([4294967295::bigint], {numbers}),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


_CRC_TABLE = """crc as (select list_transform(range(256), lambda n:
    list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""
_BYTES = """flatten(list_transform(string_split({0}, ''), lambda ch:
      case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195::bigint, unicode(ch)::bigint - 64] end))"""

_SPELLING_SQL = f"""
with recursive {_CRC_TABLE},
runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select doc_id, run, count(*) as c from runs where length(run) >= 7 group by all),
hashed as (select c, run, {_crc32_sql(_BYTES.format("doc_id || ':' || run"))} as h from counted, crc),
cut as (
  select c, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed),
words as (select word, sum(c)::bigint as n from cut where length(word) >= 7 group by word having sum(c) >= 2),
shorter as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select *, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from shorter a join shorter b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select s.word, s.n, w.word, w.n from shorter s join words w on s.cut = w.word
  union select w.word, w.n, s.word, s.n from shorter s join words w on s.cut = w.word),
best as (
  select word, n, count(*) as n_near, min_by(other, (-other_n, other)) as form, max(other_n) as form_n from near group by word, n),
forms as (select word, form, form_n from best where form_n >= 10 * n),
roots(word, root, depth) as (
  select word, form, 1 from forms union all select r.word, f.form, depth + 1 from roots r join forms f on f.word = r.root),
ends as (select word, max_by(root, depth) as root from roots group by word)
select w.word, f.form, coalesce(e.root, w.word) as root, w.n, coalesce(b.n_near, 0)::bigint as n_near, f.form_n
from words w left join best b using (word) left join forms f using (word) left join ends e using (word)
"""


@query(_SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))


def _moves_sql() -> str:
    """(state, inserted turns, initial, fault, letters, state after, cost, edit, roles of the insertions) as rows of values."""
    wanted = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    rows = []
    for state in range(4):
        now, before = state, []
        for inserted in range(3):
            for initial in "suao":
                for fault in ("fine", "lost", "cut"):
                    more = 5 if fault == "cut" else 0
                    after = wanted[now]
                    edits = [("D", now, 2)]
                    if fault != "lost":
                        edits.append(("R", after, 1 + more))
                        if initial == names[after][0]:
                            edits.append(("K", after, more))
                        if initial == "s" and now == 0:
                            edits.append(("K", 1, more))
                    for edit, to, cost in edits:
                        role = f"'{names[to]}'" if edit == "R" else "null"
                        turns = "[" + ", ".join(f"'{t}:'" for t in before) + "]"
                        rows.append(f"({state}, '{initial}', '{fault}', '{'I' * inserted + edit}', {to}, {5 * inserted + cost}, {role}, {turns}::varchar[])")
            now = wanted[now]
            before.append(names[now])
    return ", ".join(rows)


_DIALOGUE_SQL = f"""
with recursive {_CRC_TABLE},
moves(state, initial, fault, letters, after, cost, role, turns) as (values {_moves_sql()}),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32_sql(_BYTES.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"))} % 20 as kind from conversations, crc),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy from keyed where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core from damaged),
judged as (
  select *, core = '' as blank, core <> '' and again as duplicate, core <> '' and not again and right(core, 1) not in ('.', '!', '?') as truncated,
    substr(role, 1, 1) as head, lag(substr(role, 1, 1)) over (partition by conv_id order by pos) as head_before from placed),
lined as (
  select *, case when head in ('s', 'u', 'a') then head else 'o' end as initial,
    case when blank or duplicate then 'lost' when truncated then 'cut' else 'fine' end as fault from judged),
paths(conv_id, pos, state, cost, audit, repaired) as (
  select distinct conv_id, 0::bigint, 0, 0, '', []::varchar[] from lined
  union all
  select conv_id, pos, after, cost, audit, repaired from (
    select l.conv_id, l.pos, m.after, p.cost + m.cost as cost, p.audit || m.letters as audit,
      list_concat(p.repaired, m.turns, case when m.letters like '%D' then [] else [coalesce(m.role, l.role) || ':' || l.text] end) as repaired
    from paths p join lined l on l.conv_id = p.conv_id and l.pos = p.pos + 1
      join moves m on m.state = p.state and m.initial = l.initial and m.fault = l.fault)
  qualify row_number() over (partition by conv_id, after order by cost, audit) = 1),
ends as (
  select conv_id, cost + case state when 1 then 10 when 2 then 5 else 0 end as cost,
    audit || case state when 1 then 'II' when 2 then 'I' else '' end as audit,
    list_concat(repaired, case state when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end) as repaired
  from paths p where pos = (select max(pos) from lined l where l.conv_id = p.conv_id)),
cheapest as (select * from ends qualify row_number() over (partition by conv_id order by cost, audit) = 1),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (head_before is not null and head_before || head not in ('su', 'ua', 'au')) as illegal from judged group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') as audit, sha256(coalesce(array_to_string(repaired, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts using (conv_id) left join cheapest using (conv_id)
"""


@query(_DIALOGUE_SQL)
def op13_dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogues.repair(spark.read.parquet(f"{folder}/conversations.parquet"), damaged=True)
