"""The queries of this folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailprism.llm.collocations import collocations
from mailprism.llm.common import documents
from mailprism.llm.exact_dedup import exact_dedup
from mailprism.llm.html_extract import extract
from mailprism.llm.jaccard_join import near_texts
from mailprism.llm.lexical_search import search
from mailprism.llm.line_dedup import line_dedup_report
from mailprism.llm.mixing import mix
from mailprism.llm.quality import quality_rules
from mailprism.llm.secret_scan import scan
from mailprism.llm.simhash import near_duplicates
from mailprism.llm.substring_dedup import remove_repeats
from mailprism.llm.token_files import token_report
from mailprism.llm.viterbi_pieces import encoded_and_decoded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


@query
def op2_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


@query
def op3_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))


@query
def op4_sentencepiece(spark, sf_dir):
    return encoded_and_decoded(documents(spark, sf_dir))


@query
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


@query
def op6_quality(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir))


@query
def op7_token_files(spark, sf_dir):
    return token_report(documents(spark, sf_dir))


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup_report(documents(spark, sf_dir))


@query
def op9_secrets(spark, sf_dir):
    return scan(documents(spark, sf_dir))


@query
def op10_main_text(spark, sf_dir):
    return extract(documents(spark, sf_dir, "pages"))


@query
def op11_lexical_search(spark, sf_dir):
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query
def op12_jaccard_join(spark, sf_dir):
    return near_texts(documents(spark, sf_dir))


@query
def op13_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))
