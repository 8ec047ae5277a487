"""One query per training-data operator, each over its whole table, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, extraction, infill, langid, matroska, mixing, neardup, ngram_join, oracles, pieces, quantize, secrets, sharding
from .common import load, materialize

#: A SentencePiece model with byte pieces; any other can be given.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: A BPE tokenizer with word ends; any other of its kind can be given.
WORD_BPE = "/opt/tokenizers/word_bpe_49k.json"
#: Bytes of a batch of rows that goes to Python, but for a longer single row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long, so few go to Python at once: at most 200, and no more once BATCH_BYTES are reached."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are read once: what mixing has to know of them is a narrow table.
    rows = materialize(mixing.measured(load(spark, sf_dir, "documents"), keep=["doc_id"]))
    mixed = mixing.mix_measured(rows)
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    stored = matroska.with_media(docs).select(F.struct("doc_id", n_bytes.alias("n_bytes")).alias("key"), "media")
    return matroska.digests(stored, doc_id="key").select("doc_id.*", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.join(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op4_unigram_pieces(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """Per document its ids, their number, and whether decoding gives its text back."""
    small_batches(spark)
    v = pieces.from_model(model)
    coded = pieces.decode(pieces.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), v), v)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"), "token_ids")


def op5_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(load(spark, sf_dir, "documents").select("doc_id"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.RULES]

    def n_of(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kinds.index(kind))).cast("bigint").alias(f"n_{kind}")

    base = F.filter("_spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select("doc_id", *map(n_of, secrets.BASE), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("_spans")).alias("spans"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedup(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = extraction.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"), extraction.trees(spark))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation -1 of the table stays apart from the added one.
    both = rows.withColumn("added", F.lit(False)).unionByName(chat.conflict(spark).withColumn("added", F.lit(True)))
    return chat.digests(both, by=("conv_id", "added")).drop("added")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = quantize.fit_and_code(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=("label",))
    rows = materialize(coded.rows.select("key.vec_id", "key.label", F.lower(F.hex("code")).alias("code"), "error"))
    summed = quantize.with_group_sums(rows, F.col("label"), F.col("error"), "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(coded.books.sha256()).alias("codebooks_sha256"))


def op12_word_bpe(spark: SparkSession, sf_dir: str, model: str = WORD_BPE) -> DataFrame:
    small_batches(spark)
    m = bpe.from_file(model)
    coded = bpe.as_bytes(bpe.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), m).drop("text"))
    n_tokens = F.size("token_ids").cast("bigint").alias("n_tokens")
    return bpe.decode(coded, m).select("doc_id", n_tokens, F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = infill.transform(load(spark, sf_dir, "documents").select("doc_id", "text"))
    text = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_pareto_mix, op2_matroska, op3_ngram_join, op4_unigram_pieces, op5_lookup_sharding, op6_secret_scan, op7_embedding_neardup, op8_language_id, op9_main_text, op10_chat_round_trip, op11_vector_codes, op12_word_bpe, op13_fill_in_middle)}

#: The others have no SQL form: their tests hold them against brute force, round trips or held-out rows.
ORACLES = {
    "op1_pareto_mix": oracles.MIX,
    "op3_ngram_join": oracles.NGRAM_JOIN,
    "op5_lookup_sharding": oracles.SHARDING,
    "op6_secret_scan": oracles.SECRETS,
    "op7_embedding_neardup": oracles.EMBEDDINGS,
    "op10_chat_round_trip": oracles.CHAT,
    "op11_vector_codes": oracles.VECTOR_CODES,
    "op13_fill_in_middle": oracles.INFILL,
}
