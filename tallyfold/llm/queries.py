"""Registered queries of this subpackage, one per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import embeddings, exact_dedup, fingerprint, langid, licenses, merkle, mixing, packing, pii, prefix_trie, simhash, sql_twins, toxicity, urlfilter
from tallyfold.llm.common import hex64, staged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return add


# ------------------------------------------------------------------------------------ 1 mixing to target weights

MIX_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "d0/en": 3, "d1/en": 3, "d2/en": 3, "d3/en": 3, "d0/en/src0": 2}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 3, 42


def mix_levels() -> dict[str, Column]:
    """Domain, language, source; the domain is the source's number modulo 4, "other" without a number."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src([0-9]{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), F.pmod(F.expr("try_cast(regexp_extract(source, '^src([0-9]{1,9})$', 1) as int)"), F.lit(4)).cast("string"))).otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def _sql_level(depth: int) -> str:
    """Budgets of the nodes of one level from those of the level above."""
    names = ["domain", "lang", "source"][:depth]
    key, parent = ", ".join(names), ", ".join(names[:-1])
    part = f"partition by {parent}" if parent else ""
    path = " || '/' || ".join(names)
    above = f"join level{depth - 1} p using ({parent})" if parent else ""
    budget = "p.got" if parent else "(select wanted from goal)"
    return f"""
    nodes{depth} as (
      select {key}, {budget} as b, coalesce(w.w, 1) as w, case when coalesce(w.w, 1) > 0 then c else 0 end as c
      from (select {key}, sum(tokens * {MIX_EPOCHS})::bigint as c from leaves group by {key}) n {above}
      left join weights w on w.path = {path}),
    run{depth} as (
      select *, b - coalesce(sum(c) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as lft,
        (sum(w) over ({part}) - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0))::bigint as opn,
        row_number() over o as i
      from nodes{depth}
      window o as ({part} order by case when w > 0 then c::double / w else 'inf'::double end, {key})),
    stop{depth} as (
      select {key}, c, w, i, lft, opn, case when w > 0 and (lft::hugeint * w) // opn < c then i end as short from run{depth}),
    first{depth} as (select *, min(short) over ({part}) as hit from stop{depth}),
    level{depth} as (
      select {key}, case when hit is null or i < hit or w = 0 then c
        else least((max(case when i = hit then lft end) over ({part}) * w) // max(case when i = hit then opn end) over ({part}), c) end as got
      from first{depth})"""


ORACLE_MIX = f"""
with words as (
  select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens,
    case when regexp_matches(source, '^src[0-9]{{1,9}}$') then 'd' || (substr(source, 4)::bigint % 4) else 'other' end as domain
  from documents),
docs as (select * from words where tokens > 0),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens from docs group by all),
goal as (select trunc({MIX_SHARE} * sum(tokens))::bigint as wanted from leaves),
weights as (select * from (values {", ".join(f"('{k}', {v})" for k, v in MIX_WEIGHTS.items())}) t(path, w)),
{",".join(_sql_level(d) for d in (1, 2, 3))},
epochs as (
  select domain, lang, source, unnest(range(0, (got::bigint - 1) // tokens + 1)) as epoch, got::bigint as budget, tokens as size
  from level3 join leaves using (domain, lang, source) where got > 0),
placed as (
  select d.*, epoch, least(size, budget - epoch * size) as room,
    coalesce(sum(tokens) over (partition by domain, lang, source, epoch
      order by ('0x' || substr(md5('{MIX_SEED}:' || epoch || ':' || doc_id), 1, 15))::bigint, doc_id
      rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from docs d join epochs using (domain, lang, source))
select domain, lang, source, doc_id, tokens, epoch, start, least(tokens, room - start)::bigint as taken from placed where start < room"""


@query("op1_source_mixing", ORACLE_MIX)
def op1(spark, d):
    plan = mixing.mix_plan(table(spark, d, "documents"), mix_levels(), share=MIX_SHARE, weights=MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return plan.drop("_hash")


# ------------------------------------------------------------------------------------------------- 5 toxicity


@query("op5_toxicity_severity")
def op5(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit_severity(docs, toxicity.label_grades(table(spark, d, "labels")), n_grades=3)
    return toxicity.score_severity(docs, model).select("doc.doc_id", "severity", "p_toxic", "toxic")


# -------------------------------------------------------------------------------------- 6 SimHash near duplicates


@query("op6_simhash_near_dedup")
def op6(spark, d):
    found = simhash.near_classes(table(spark, d, "documents"))
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


# ------------------------------------------------------------------------------------------ 8 exact duplicates


@query(
    "op8_exact_dedup",
    """select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
         doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
       from (select doc_id, coalesce(text, '') as t from documents)""",
)
def op8(spark, d):
    return exact_dedup.exact_classes(table(spark, d, "documents"))


# ------------------------------------------------------------------------------------------- 10 best-fit packing


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_pattern_packing")
def op10(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), tokenizer_file())


# --------------------------------------------------------------------------------------------------- 2 url filters

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op2_redirect_equivalence", sql_twins.URLS)
def op2(spark, d):
    return urlfilter.judge_urls(table(spark, d, "pages"), urlfilter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


# --------------------------------------------------------------------------------------------------- 7 language id


@query("op7_language_spans")
def op7(spark, d):
    docs = table(spark, d, "documents")
    model = langid.fit_languages(docs.where(~langid.held_out()))
    found = langid.detect(docs, model, spans=False)
    return found.select(F.col("doc.doc_id").alias("doc_id"), langid.held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


# ----------------------------------------------------------------------------------- 9 near-duplicate embeddings


@query("op9_embedding_near_dedup")
def op9(spark, d):
    return embeddings.embedding_classes(table(spark, d, "embeddings"))


# -------------------------------------------------------------------------------------------------- 3 license scans


@query("op3_license_diagonals", sql_twins.licenses(licenses.templates(), licenses.NEAR, licenses.WEAK, licenses.MISSING, licenses.LOST, licenses.LEAST_COVER))
def op3(spark, d):
    return licenses.license_scan(table(spark, d, "documents")).drop("spans")


# ---------------------------------------------------------------------------------------------------------- 4 PII


@query("op4_pii_candidates")
def op4(spark, d):
    return pii.pii_digest(pii.personal_spans(table(spark, d, "documents")))


# --------------------------------------------------------------------------------------------- 11 fingerprints

NEAR_BITS = 5


@query("op11_document_fingerprints")
def op11(spark, d):
    """Documents whose id is divisible by 20 are searched for; ``n_near`` counts the other documents within 5 of 128 bits."""
    made = staged(fingerprint.edited_fingerprints(table(spark, d, "documents")), "fingerprints")
    copies = made.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    found = fingerprint.within_radius(made.where("doc_id % 20 = 0"), made, NEAR_BITS)
    near = found.join(copies, ["hi", "lo"]).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg((F.sum("n") - 1).alias("n_near"))
    asked = made.where("doc_id % 20 = 0").join(near, ["hi", "lo"])
    rest = made.where("not coalesce(doc_id % 20 = 0, false)").withColumn("n_near", F.lit(None).cast("bigint"))
    alike = lambda hi, lo: fingerprint.likeness(F.col("hi"), F.col("lo"), F.col(hi), F.col(lo))
    shown = lambda hi, lo: F.concat(hex64(hi), hex64(lo))
    return asked.unionByName(rest).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("hi", "lo").alias("fingerprint"),
        shown("edited_hi", "edited_lo").alias("edited_fingerprint"),
        alike("edited_hi", "edited_lo").alias("near_edited"),
        alike("next_hi", "next_lo").alias("near_next"),
        "n_near",
    )


# ------------------------------------------------------------------------------------------ 12 Merkle manifest

MERKLE_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@query("op12_merkle_manifest")
def op12(spark, d):
    claims = merkle.tampered_leaf("doc_id", MERKLE_COLUMNS, "text", 5)
    return merkle.manifest(table(spark, d, "documents"), "doc_id", MERKLE_COLUMNS, "source", claims)


# ------------------------------------------------------------------------------------- 13 conversation prefix trie


@query("op13_conversation_trie")
def op13(spark, d):
    turns = staged(prefix_trie.ordered_turns(table(spark, d, "conversations")), "turns")
    return prefix_trie.prefix_nodes(*prefix_trie.rebuilt_turns(turns))
