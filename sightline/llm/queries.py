"""Thin queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    from sightline.llm.decontaminate import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), span=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of all documents."""
    from sightline.llm.quality import judge_quality

    judged = judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of all documents: low quality first, then toxic."""
    from sightline.llm.toxicity import score_toxicity

    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = score_toxicity(_table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])
    return scored.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("is_toxic").alias("toxic"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents."""
    from sightline.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=5, percent=75)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    from sightline.llm.packing import pack

    packed = pack(_table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated byte strings of all documents removed."""
    from sightline.llm.repeats import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered role and canonical form of every turn of all conversations."""
    from sightline.llm.chat import format_chats

    return format_chats(_table(spark, sf_dir, "conversations"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    from sightline.llm.pii import KINDS, find_pii, span_digest

    found = find_pii(_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"), span_digest(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    from sightline.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to token files and read back."""
    from sightline.llm.common import scratch_path
    from sightline.llm.token_files import read_token_files, write_token_files

    folder = scratch_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=0)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_packing": op5_packing,
    "op6_repeats": op6_repeats,
    "op7_chat": op7_chat,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_token_files": op10_token_files,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM, _WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def _words_sql(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key} AS id, regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'),'{pattern}') AS w FROM {table}"


_OP1_SQL = f"""WITH d AS ({_words_sql('documents', 'doc_id', _ALNUM)}), b AS ({_words_sql('benchmark', 'item_id', _ALNUM)}),
bn AS (SELECT id, w, least(10,len(w)) AS n FROM b WHERE len(w)>0),
win AS (SELECT DISTINCT id, n, array_to_string(w[i:i+n-1],' ') AS g FROM (SELECT *, unnest(range(1,len(w)-n+2)) AS i FROM bn)),
dwin AS (SELECT id, i, n, array_to_string(w[i:i+n-1],' ') AS g FROM (SELECT d.id, d.w, s.n, unnest(range(1,len(d.w)-s.n+2)) AS i FROM d, (SELECT DISTINCT n FROM win) s WHERE len(d.w)>=s.n)),
hit AS (SELECT dwin.id, dwin.i, dwin.n, win.id AS item FROM dwin JOIN win ON dwin.n=win.n AND dwin.g=win.g),
words AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i,i+n)) AS p FROM hit) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS names FROM hit GROUP BY id)
SELECT d.id AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n,0)::BIGINT AS n_hit, coalesce(items.n,0)::BIGINT AS n_items, sha256(coalesce(items.names,'')) AS items_sha256, coalesce(words.n,0)>0 AS contaminated
FROM d LEFT JOIN words USING (id) LEFT JOIN items USING (id)"""


def _op2_sql() -> str:
    from sightline.llm.quality import CAPITALS, MARKS, METRICS, PRIOR, REACH, SIGMAS, SPREAD, SYMBOLS

    count = lambda c: f"length(regexp_replace(text,'[^{c}]+','','g'))::BIGINT"
    names = ",".join(f"'{m}'" for m in METRICS)
    rates = ",".join(f"1000*{k}//greatest({n},1)" for k, n, _ in METRICS.values())
    bounds = ",".join(f"floor(1000::DOUBLE*({k}-{SIGMAS}::DOUBLE*sqrt(({k}*{u})::DOUBLE))/greatest({n},1))::BIGINT" for k, n, u in METRICS.values())

    def quartiles(keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        return f"""(SELECT {by}, max(docs) AS docs, min(bucket) FILTER (upto*4>=docs) AS lo, min(bucket) FILTER (upto*4>=docs*2) AS mid FROM (
        SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS docs FROM (SELECT {by}, bucket, sum(n) AS n FROM sk GROUP BY {by}, bucket)) GROUP BY {by})"""

    mixed = lambda c: f"((o.docs*o.{c} + {PRIOR}*((l.docs*l.{c} + {PRIOR}*a.{c})//(l.docs+{PRIOR})))//(o.docs+{PRIOR}))"
    return rf"""WITH t AS (SELECT doc_id, coalesce(lang,'') AS lang, coalesce(source,'') AS source, coalesce(text,'') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text,'{_WORD}') AS ws, list_filter(string_split(text,chr(10)), lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i]||' '||ws[i+1]||' '||ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1,len(ws)-1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i,i+1,i+2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c>1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws,''))::BIGINT AS word_chars, {count(SYMBOLS)} AS n_symbols, {count(CAPITALS)} AS n_capitals, {count(MARKS)} AS n_marks,
  len(ls)::BIGINT AS n_lines, (len(ls)-len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n,0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT doc_id, lang, source, unnest([{names}]) AS metric, unnest([{rates}]) AS v, unnest([{bounds}]) AS b FROM m),
sk AS (SELECT lang, source, metric, v-v%(1<<greatest(length(bin(v))-5,0)) AS bucket, count(*) AS n FROM v GROUP BY ALL),
f AS (SELECT o.lang, o.source, o.metric, {mixed('lo')} AS lo, {mixed('mid')} AS mid FROM {quartiles('lang, source')} o JOIN {quartiles('lang')} l USING (lang, metric) JOIN {quartiles('')} a USING (metric)),
bad AS (SELECT doc_id, bool_or(b>mid+{REACH}*greatest(mid-lo,{SPREAD})) AS bad FROM v JOIN f USING (lang, source, metric) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words<50 OR 100*n_repeat_words>50*n_words AS base_failed, NOT (n_words<50 OR 100*n_repeat_words>50*n_words) AND NOT bad AS kept FROM m JOIN bad USING (doc_id)"""


_OP4_SQL = f"""WITH RECURSIVE d AS ({_words_sql('documents', 'doc_id', _WORD)}),
s AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w,' ')] ELSE list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) END) AS g FROM d)),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
e AS (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g=y.g AND x.id<>y.id GROUP BY ALL) JOIN z p ON p.id=a JOIN z q ON q.id=b WHERE 100*c>=75*(p.n+q.n-c)),
r AS (SELECT id, id AS c FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.c=e.a)
SELECT d.id AS doc_id, coalesce(z.n,0)::BIGINT AS n_shingles, k.c AS component_id, k.c=d.id AS kept FROM d JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) k USING (id) LEFT JOIN z USING (id)"""

#: The other operators' results (tokenizer ids, models, byte spans) are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OP1_SQL, "op2_quality": _op2_sql(), "op4_near_duplicates": _OP4_SQL}
