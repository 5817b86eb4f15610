"""The queries of this subpackage: thin wrappers that apply its operators, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.ngram_join import Threshold, jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), width=4, t=Threshold(85, 100)).select("doc_id", "n_shingles", "component_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.chat_format import formatted

    return formatted(table(spark, sf_dir, "conversations"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.fingerprints import fingerprints_beside_edits

    return fingerprints_beside_edits(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.pii import KINDS, personal_data

    names = F.array(*map(F.lit, KINDS))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def many(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [many(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.toxicity import score_documents, train, trains

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~trains()).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.url_filter import judged, rule

    rules = [rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/")]
    return judged(table(spark, sf_dir, "pages"), rules)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.suffix_dedup import shared_passages, without_repeats

    docs = table(spark, sf_dir, "documents")
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    found = without_repeats(docs).select("doc_id", "hash", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    shared = shared_passages(docs).alias("s")
    both = found.alias("f").join(shared, F.expr("f.hash = s.hash and f.doc_id <=> s.doc_id"), "left")
    return both.select("f.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeat"), F.col("s.hash").isNotNull().alias("shares_passage"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.decontamination import contamination, is_contaminated

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.llm.license_scan import licences, train

    found = licences(table(spark, sf_dir, "documents"), train(spark))
    return found.select("doc_id", "n_paragraphs", "n_licence", F.array_join("families", ",").alias("families"), "doubtful")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from billweave.llm.bpe import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_chat_format, op3_document_fingerprints, op4_pii, op5_toxicity, op6_url_filter,
        op7_suffix_dedup, op8_decontamination, op9_license_scan, op10_byte_bpe,
    )
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')".format(lower=_LOWER)

#: DuckDB's SQL for the queries that SQL can express. The operators of the others are tested against plain versions, op2 by hand-made
#: cases, op5 and op9 by held-out accuracy besides.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""with recursive w as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\x09-\x0D\x20]+'), lambda w: w <> '') as ws from documents),
      s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)),
      n as (select doc_id, count(*) as n from s group by doc_id),
      p as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
      link as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 85 * (a.n + b.n - o)),
      e as (select x, y from link union select y, x from link),
      reach as (select distinct x as doc_id, x as seen from e union select e.y, r.seen from reach r join e on e.x = r.doc_id),
      c as (select doc_id, min(seen) as component_id from reach group by doc_id)
      select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id""",
    "op8_decontamination": rf"""with d as (select doc_id, {_WORDS} as ws from documents), i as (select item_id, {_WORDS} as ws from benchmark),
      win as (select distinct cast(item_id as varchar) as item_id, least(len(ws), 13) as k, array_to_string(ws[p:p + least(len(ws), 13) - 1], ' ') as g from (select *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as p from i where len(ws) > 0)),
      run as (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as p from d cross join (select distinct k from win) where len(ws) >= k),
      m as (select doc_id, p, run.k, item_id from run join win on win.k = run.k and win.g = array_to_string(ws[p:p + run.k - 1], ' ')),
      h as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + k)) as q from m) group by doc_id),
      t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from m) group by doc_id)
      select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.ws) as contaminated
      from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id""",
}
