"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paylake.llm import (cap_filters, decontaminate, fixity, langid, minhash, packing, sharding, source_divergence, suffix_dedup, token_orc, toxicity,
                         turn_repair, url_filter)
from paylake.llm.common import Scratch
from paylake.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op9_token_orc")
def op9(spark, sf_dir):
    path = Scratch(spark, "orc").path("ids")
    token_orc.write_ids(read_table(spark, sf_dir, "documents"), path)
    return token_orc.digests(token_orc.read_ids(spark, path))


@query("op3_language_id")
def op3(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op6_pu_toxicity")
def op6(spark, sf_dir):
    return toxicity.detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_url_vocabulary", url_filter.sql())
def op7(spark, sf_dir):
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op8_circulant_minhash")
def op8(spark, sf_dir):
    return minhash.components(read_table(spark, sf_dir, "documents"))


@query("op4_cap_filters")
def op4(spark, sf_dir):
    return cap_filters.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op2_qgram_decontamination")
def op2(spark, sf_dir):
    return decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op10_induced_suffix_dedup")
def op10(spark, sf_dir):
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"))


@query("op5_merkle_fixity", fixity.sql())
def op5(spark, sf_dir):
    return fixity.audit_pages(read_table(spark, sf_dir, "pages"))


@query("op11_persistent_audit", turn_repair.sql())
def op11(spark, sf_dir):
    return turn_repair.repair(turn_repair.damage(read_table(spark, sf_dir, "conversations"))).drop("starts_system")


@query("op12_best_fit_shards")
def op12(spark, sf_dir):
    return sharding.by_bytes(read_table(spark, sf_dir, "documents"))


@query("op13_source_divergence", source_divergence.sql())
def op13(spark, sf_dir):
    return source_divergence.audit(read_table(spark, sf_dir, "documents"))
