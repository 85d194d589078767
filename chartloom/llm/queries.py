"""Registered queries of this subpackage, each over whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm.byte_bpe import decode_documents, encode_documents
from chartloom.llm.decontaminate import find_leaks
from chartloom.llm.filter_audit import AUDIT_SQL, audit_filters
from chartloom.llm.fingerprints import fingerprint_edits
from chartloom.llm.html_text import extract_main_text
from chartloom.llm.jaccard_join import near_copies
from chartloom.llm.language_id import identify_languages
from chartloom.llm.license_scan import scan_licences
from chartloom.llm.packing import pack_documents
from chartloom.llm.substring_dedup import repeated_passages
from chartloom.llm.token_alignment import align_tokenizers
from chartloom.llm.token_counts import count_tokens
from chartloom.llm.url_filter import judge_urls
from chartloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 512
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_REGISTRY: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def llm_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def llm_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op2_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )


@_query
def op4_url_filters(spark, sf_dir):
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op5_language_id(spark, sf_dir):
    return identify_languages(read_table(spark, sf_dir, "documents"))


@_query
def op7_fingerprints(spark, sf_dir):
    """Fingerprints as ``position:hash`` of the kept runs, joined by blanks; the operator gives arrays."""
    shown = lambda name: F.array_join(
        F.transform(name, lambda run: F.concat_ws(":", run["position"].cast("string"), run["hash"].cast("string"))), " "
    )
    prints = fingerprint_edits(read_table(spark, sf_dir, "documents"))
    return prints.withColumns({name: shown(name) for name in ("fingerprint", "edited_fingerprint")})


@_query
def op10_ngram_jaccard(spark, sf_dir):
    return near_copies(read_table(spark, sf_dir, "documents")).drop("digest")


@_query
def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query
def op3_html_extraction(spark, sf_dir):
    return extract_main_text(read_table(spark, sf_dir, "pages"))


@_query
def op6_license_scans(spark, sf_dir):
    return scan_licences(read_table(spark, sf_dir, "documents"))


@_query
def op1_substring_dedup(spark, sf_dir):
    return repeated_passages(read_table(spark, sf_dir, "documents"))


@_query
def op9_benchmark_decontamination(spark, sf_dir):
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op11_byte_bpe(spark, sf_dir):
    """Token count and digests of every document's ids and of what they decode to."""
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = encode_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode_documents(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@_query
def op12_filter_audit(spark, sf_dir):
    """What five filters remove from each language under each of their 120 orders."""
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_ORACLES["op12_filter_audit"] = AUDIT_SQL


@_query
def op13_tokenizer_alignment(spark, sf_dir):
    """Groups and links of a byte-level and a piece tokenizer in every document."""
    docs = read_table(spark, sf_dir, "documents")
    aligned = align_tokenizers(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return aligned.withColumnRenamed("groups", "groups_sha256")
