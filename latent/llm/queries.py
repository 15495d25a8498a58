"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latent.llm import (align, bpe, decontaminate, html, licences, lm, pii, shard, simhash, sketch,
                        toxicity, variants, warc)
from latent.llm.common import fold_of, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def byte_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learn=~toxicity.held_out())
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_sentences",
        F.size("offending").alias("n_offending"))


@query("op2_html")
def op2(spark, sf_dir):
    return html.main_texts(table(spark, sf_dir, "pages"))


@query("op3_lm")
def op3(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"), fold_of("doc_id", 10) == 0, byte_bpe_path())


@query("op4_sketch")
def op4(spark, sf_dir):
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


BASE32 = """array_to_string([
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)
  for v in [cast('0x' || substr(x, 5 * i + 1, 5) as bigint) for i in range(0, 8)]], '')"""


@query("op5_warc", f"""
with d as (select page_id, url, strlen(coalesce(html, '')) as b, sha1(coalesce(html, '')) as x
           from pages),
f as (select x, min(page_id) as m from d group by x)
select page_id, url, b as payload_bytes, {BASE32} as payload_digest,
       case when page_id = m then 'response' else 'revisit' end as record_type,
       case when page_id <> m then m end as refers_to
from d join f using (x)""")
def op5(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_licences")
def op6(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op7_shard")
def op7(spark, sf_dir):
    return shard.shards(table(spark, sf_dir, "documents"))


@query("op8_decontaminate", r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w
           from documents),
ds as (select distinct doc_id, unnest([array_to_string(w[i:i + 4], ' ')
           for i in range(1, greatest(len(w) - 4, 1) + 1)]) as shingle from d where len(w) > 0),
i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w
      from benchmark),
s as (select distinct item_id, unnest([array_to_string(w[i:i + 4], ' ')
          for i in range(1, greatest(len(w) - 4, 1) + 1)]) as shingle from i where len(w) > 0),
m as (select item_id, count(*) as item_shingles from s group by item_id)
select doc_id, item_id, item_shingles, count(*) as shared, count(*) / item_shingles as containment
from ds join s using (shingle) join m using (item_id)
group by doc_id, item_id, item_shingles having count(*) >= 0.8 * item_shingles""")
def op8(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query("op9_simhash")
def op9(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@query("op10_bpe")
def op10(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), byte_bpe_path())


@query("op11_pii")
def op11(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op12_variants")
def op12(spark, sf_dir):
    return variants.group(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13(spark, sf_dir):
    return align.align(table(spark, sf_dir, "documents"), byte_bpe_path(), piece_bpe_path())
