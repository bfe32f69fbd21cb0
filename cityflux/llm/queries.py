"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..sources.testdata import table
from .align import align
from .chat import as_chain, format_paths, parsed, under_loss
from .exact_dedup import exact_duplicates
from .idfiles import read_checksums, write_ids
from .language import identify
from .line_dedup import dedup_lines
from .multi_index import nearest
from .packing import TOKENIZER, added_tokens, best_fit, token_pieces
from .periods import periodic_runs
from .pieces import decode, encode
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .tables import stored
from .toxicity import score


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"))
    return nearest(vectors, asked, k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # what is left, for readers of text: a character cut in two shows as U+FFFD
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), added=added_tokens(TOKENIZER))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return best_fit(stored(digests, "pieces"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


# a conversation whose texts look like control strings
TRICKY = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_paths(stored(as_chain(given.unionByName(extra)), "messages"))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = out.select(
        F.col("tree").alias("conv_id"),
        parsed(F.col("formatted")).alias("turns"),
        under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "id-files")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_checksums(spark, path)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The documents with a periodic end in those whose id's crc32 is a multiple of ten."""
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    sized = marked.select("doc_id", "text", "h", "g", F.when(F.col("h") % 10 == 0, words).alias("words"))
    a = F.expr("g % size(words)")
    p = F.expr("1 + (size(words) - g % size(words)) div (3 + g % 8)")
    told = sized.withColumn("a", F.when(F.size("words") > 0, a)).withColumn("p", F.when(F.size("words") > 0, p))
    folded = F.expr("transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)]))")
    return told.select("doc_id", F.when(F.size("words") > 0, F.array_join(folded, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.expr(
        "array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))"
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.select("doc_id", "runs", "collapsed", longest.alias("best"), lines.alias("lines"))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_multi_index": op1_multi_index,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_id_files": op11_id_files,
    "op12_align": op12_align,
    "op13_periodic_runs": op13_periodic_runs,
}
