"""Queries of the operators on texts."""

from __future__ import annotations

from tidemark.llm import encode, leakage, main_content, spam, template_residue
from tidemark.session import spread, table


def p2_found(spark, sf_dir):
    found = main_content.main_blocks(spread(table(spark, sf_dir, "extracted_pages")))
    return found.select("page_id", "block_field", "block_no").distinct()


def p3_found(spark, sf_dir):
    return template_residue.residue_pages(spread(table(spark, sf_dir, "extracted_pages"))).select("page_id")


def p6_ids(spark, sf_dir):
    return encode.token_ids(spark, spread(table(spark, sf_dir, "documents")))


def p7_found(spark, sf_dir):
    found = leakage.leaked_items(spark, spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_found(spark, sf_dir):
    return spam.spam_pages(spread(table(spark, sf_dir, "documents")))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

ORACLE: dict[str, str] = {}
