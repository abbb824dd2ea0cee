"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductwise.llm import ann, langid, linededup, maxent, minhash, packing, periodic, quality, sentencepiece, simhash, tokenfile, toxicity, vectorcodes
from ductwise.llm.common import table, words


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: in the folder TOKENIZERS_DIR if that is set, else where the installed package has it."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities and verdicts; `toxic` is the verdict of the last category."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return toxicity.score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "is_low_quality", F.col("is_toxic").alias("toxic"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after repeated runs are taken out, and the number of words taken."""
    return linededup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed").select("doc_id", "text", F.col("n_removed").cast("long").alias("n_removed"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality.STATS, "base_failed", "kept")


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=0)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of three-word shingles and its component at a similarity of 0.85; see minhash.near_duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and errors of every usable vector; see vectorcodes.compress."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", parts=16, entries=64, rounds=2, scale=256)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a repeated passage in the documents whose id's checksum is divisible by ten; null texts and ids as they are."""
    h, w = F.crc32(F.col("doc_id").cast("string").cast("binary")), words(F.col("text"))
    n, g = F.size(w), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document as digests, and its strongest run; see periodic.periodic_runs."""
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), keep=["doc_id"])
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    best = F.col("strongest_")
    return found.select(
        "doc_id", F.size("runs_").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs_", line), "")).alias("runs_sha256"), digest(F.col("collapsed_")).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_simhash, op3_token_file, op4_langid, op5_sentencepiece, op6_ann, op7_linededup, op8_quality, op9_maxent, op10_packing, op11_minhash, op12_vector_codes, op13_periodic)
}

_OP8 = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
g as (
  select doc_id, pos, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as gram
  from w window o as (partition by doc_id order by pos)),
r as (select doc_id, pos, count(*) over (partition by doc_id, gram) as n from g where gram is not null),
c as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([pos, pos + 1, pos + 2]) as p from r where n > 1) group by doc_id),
s as (
  select d.doc_id, text, words, lines, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 10 * n_dup_lines > 3 * len(lines) or 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > word_chars
    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines)
    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•*]'))) > 9 * len(lines)
    or 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words) as kept
from b
"""

_OP12 = """
with recursive v as (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as x
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
p as (
  select rid, vec_id, label, part, x[part * d + 1 : (part + 1) * d] as x
  from (select *, len(x) // 16 as d, unnest(range(16)) as part from v)),
start as (
  select part, row_number() over (partition by part order by vec_id, x) - 1 as entry, x
  from p where rid in (select rid from v order by vec_id nulls last, x limit 64)),
books as (
  select 0 as round, part, entry, x from start
  union all
  select b.round + 1, b.part, b.entry, coalesce(m.x, b.x)
  from books b left join (
    select part, entry, list(floor(total / used)::bigint order by k) as x
    from (
      select part, entry, k, sum(x[k]) as total, count(*) as used
      from (
        select p.part, arg_min(c.entry, list_aggregate(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')::bigint * 64 + c.entry) as entry,
          any_value(p.x) as x, unnest(range(1, len(any_value(p.x)) + 1)) as k
        from p join books c on c.part = p.part group by p.rid, p.part)
      group by part, entry, k)
    group by part, entry) m on m.part = b.part and m.entry = b.entry
  where b.round < 2),
final as (select part, entry, x from books where round = 2),
coded as (
  select p.rid, p.part, min(list_aggregate(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')::bigint * 64 + c.entry) as best
  from p join final c on c.part = p.part group by p.rid, p.part),
sums as (
  select rid, string_agg(printf('%02x', (best % 64)::int), '' order by part) as code, sum(best // 64)::bigint as error
  from coded group by rid)
select v.vec_id, s.code, s.error, (sum(s.error) over (partition by v.label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from final) as codebooks_sha256
from v join sums s on s.rid = v.rid
"""

_OP13 = r"""
with ids as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::ubigint)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
        lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end)) as crc
  from documents),
h as (select rid, doc_id, words, len(words) as n, xor(crc, 4294967295::ubigint)::bigint as h, (xor(crc, 4294967295::ubigint)::bigint) // 10 as g from ids),
a as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from h),
q as (select *, case when a is not null then 1 + (n - a) // (3 + g % 8) end as p from a),
w as (
  select rid, n, i, case when i >= a then words[(a + (i - a) % p)::bigint + 1] else words[i + 1] end as word
  from (select *, unnest(range(n)) as i from q)),
pairs as (select x.rid, x.n, x.i, y.i - x.i as q from w x join w y on x.rid = y.rid and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select rid, q, i, i - row_number() over (partition by rid, q order by i) as island from pairs),
stretches as (select rid, q, min(i) as start, count(*) + q as length from islands group by rid, q, island),
runs as (select rid, start, length, min(q) as period from stretches where length >= 6 and length >= 4 * q group by rid, start, length),
best as (
  select rid, start, length, period, row_number() over (partition by rid order by length::double / period desc, start, period) as r from runs),
listed as (select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by rid),
gone as (select distinct rid, unnest(range(start + period, start + length)) as i from runs),
kept as (select w.rid, string_agg(word, ' ' order by w.i) as text from w left join gone g on g.rid = w.rid and g.i = w.i where g.i is null group by w.rid)
select q.doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length, b.period::bigint as period,
  (1000 * b.length // b.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from q left join best b on b.rid = q.rid and b.r = 1 left join listed l on l.rid = q.rid left join kept k on k.rid = q.rid
"""

ORACLE_SQL: dict[str, str] = {"op8_quality": _OP8, "op12_vector_codes": _OP12, "op13_periodic": _OP13}
