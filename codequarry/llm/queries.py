"""Queries over the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import docpairs, handwritten, packing, spans, splitting, syntax, tokens, truncation


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where("piece = 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, folder, "files"), table(spark, folder, "sources"))


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.scored(table(spark, folder, "files"), table(spark, folder, "sources"))


def p4_heldout(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.held_out(table(spark, folder, "files"), table(spark, folder, "sources"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.broken(table(spark, folder, "files"), table(spark, folder, "sources")).select("file_id")


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.broken_rates(*(table(spark, folder, t) for t in ("files", "sources", "issues")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_pairs(table(spark, folder, "chunks"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    return spans.linked_chunks(table(spark, folder, "chunks"))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_shares(table(spark, folder, "chunks"))


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    return spans.without_shared(table(spark, folder, "chunks"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, folder, "chunks"), table(spark, folder, "files"))


def p7_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.function_pairs(table(spark, folder, "chunks"), table(spark, folder, "files"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(_sizes(spark, folder)).drop("loss")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    from codequarry.plans.workspace import materialised

    return materialised(tokens.token_counts(table(spark, folder, "documents")), "sizes")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_report(packing.fill(_sizes(spark, folder)))


#: Limits of ``p9_instruction``: of segments, and of loss-bearing tokens, those behind a text's first line (its prompt).
INSTRUCTION = {"segments": 8, "loss": "answer", "loss_capacity": 1792}


def p9_instruction(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(_sizes(spark, folder), **INSTRUCTION)


def p9_instruction_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_report(p9_instruction(spark, folder), segments=INSTRUCTION["segments"], loss_capacity=INSTRUCTION["loss_capacity"])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p4_heldout": p4_heldout,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_shares": p6_shares,
    "p6_kept": p6_kept,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_report": p9_report,
    "p9_instruction": p9_instruction,
    "p9_instruction_report": p9_instruction_report,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

ORACLE = {
    "p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE strlen(content) > 4096",
}
