"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import oracles
from rolecall.llm.ann_search import nearest_neighbours
from rolecall.llm.byte_bpe import decode_bytes, encode_bytes
from rolecall.llm.chat_format import link_tool_calls
from rolecall.llm.common import table
from rolecall.llm.decontamination import find_leaks
from rolecall.llm.jaccard_join import jaccard_components
from rolecall.llm.language_id import fit_languages, identify_languages
from rolecall.llm.lm_score import score_documents
from rolecall.llm.merkle import merkle_manifest
from rolecall.llm.packing import pack_binary
from rolecall.llm.secret_scan import joined, scan_secrets
from rolecall.llm.sentence_dedup import remove_repeated_spans
from rolecall.llm.substring_dedup import remove_repeats
from rolecall.llm.token_alignment import rate_links


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = joined(F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex")))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "lcs_share", "answer_share")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit_languages(docs.filter(~held_out))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


#: What a message must look like: the tools that `conversation_calls` derives.
CHAT_SCHEMAS = {
    "answer": {"prompt": {"type": "string", "required": True, "min_length": 1}, "words": {"type": "integer", "required": True, "minimum": 1, "maximum": 40}},
    "instruct": {"prompt": {"type": "string", "required": True, "min_length": 1}, "words": {"type": "integer", "required": True, "minimum": 1, "maximum": 20}},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation's turns stand for.

    A user turn calls `answer`, a system turn `instruct`; an assistant turn is the
    result of the turn before it. A user turn comes after the user turn two before.
    """
    def at(n: int):
        return F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + n).cast("string"))

    prompt = F.to_json(F.struct(F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("words"), F.col("text").alias("prompt")))
    calls = conversations.filter("role IN ('user', 'system')").select(
        "conv_id", "turn", at(0).alias("call_id"), F.when(F.col("role") == "user", "answer").otherwise("instruct").alias("name"), prompt.alias("arguments"),
        F.when(F.col("role") == "user", at(-2)).alias("after"),
    )
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", at(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*conversation_calls(table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(table(spark, sf_dir, "documents"), held_out)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_binary(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    of = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = decode_bytes(encode_bytes(table(spark, sf_dir, "documents"), *of), *of)
    words = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(words, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = table(spark, sf_dir, "documents")
    found = merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", tampered, {"text": lowered})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_links(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_jaccard_join, op2_sentence_spans, op3_secret_scan, op4_suffix_dedup, op5_decontamination,
        op6_language_id, op7_ann_search, op8_chat_format, op9_lm_scoring, op10_packing,
        op11_byte_bpe, op12_merkle_manifest, op13_token_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op1_jaccard_join": oracles.JACCARD,
    "op3_secret_scan": oracles.SECRETS,
    "op4_suffix_dedup": oracles.REPEATS,
    "op8_chat_format": oracles.CHAT,
    "op12_merkle_manifest": oracles.MERKLE,
}
