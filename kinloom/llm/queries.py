"""The thin queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clustering, embeddings, fingerprints, html, language, mixing, neardup, packing, pieces, quality, repeats, whitening
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), shingle=2)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(chat.PROBE))
    parts = turns.select("conv_id", "turn", "role", chat.text_part(turns["text"]).alias("parts"))
    return chat.digest(chat.format_chats(parts))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_minhash": op2_minhash,
        "op3_chat": op3_chat,
        "op4_embeddings": op4_embeddings,
        "op5_mixing": op5_mixing,
        "op6_html": op6_html,
        "op7_language": op7_language,
        "op8_quality": op8_quality,
        "op9_repeats": op9_repeats,
        "op10_packing": op10_packing,
        "op11_clustering": op11_clustering,
        "op12_whitening": op12_whitening,
        "op13_pieces": op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_fingerprints": fingerprints.oracle(),
        "op2_minhash": neardup.ORACLE,
        "op3_chat": chat.ORACLE,
        "op4_embeddings": embeddings.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "op9_repeats": repeats.ORACLE,
        "op11_clustering": clustering.oracle(),
    }
