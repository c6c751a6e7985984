"""Personal data: base patterns that always count, and further candidates that boosted trees accept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.llm.common import staged, text_of

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns.  A match can only start where the run of its first characters starts or where the last match ended,
#: which the look-behind says, so that long runs are read once; possessive loops neither go back nor recurse.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: spellings that the base patterns miss.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|\(@\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,24}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| \. )[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2,3}(?:[ ._/-]{1,2}[0-9]{1,4})?(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}|\([0-9]{2,4}\)|[0-9]{3})[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z.])",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write to|mailto|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login|client",
    "card": r"(?i)card|visa|master|amex|credit|payment|karte|tarjeta|carte",
    "phone": r"(?i)phone|tel\b|tel[.:]|call|mobile|cell|fax|whatsapp|telefon",
}
BEFORE, AFTER = 24, 12
#: Distinct candidates the trees are fitted on, at most; half of them set the thresholds instead.
MAX_CANDIDATES = 20_000
#: Calibrated chance that an accepted candidate must reach.
PRECISION = 0.98


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` and candidate (one with null kind for rows without): row, doc_id, kind, wide, start,
    end (code points, end exclusive), found, before, after.  Generators overlap freely."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))

    def pattern(kind: str, wide: bool) -> Column:
        text = F.lit((WIDE if wide else BASE)[kind])
        tried = F.col("t").rlike(r"[(\[{](?i:at|@)[)\]}]" if kind == "email" else r"[0-9]") if wide or kind not in HINT else F.contains("t", F.lit(HINT[kind]))

        both = F.struct(F.regexp_extract_all("t", text, F.lit(0)).alias("found"), F.split("t", (WIDE if wide else BASE)[kind], -1).alias("gaps"))
        # the pair is computed once: it becomes a lambda variable
        listed = F.transform(F.array(both), lambda g: F.transform(g["found"], lambda m, at: F.struct(
            F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), at.alias("at"), m.alias("found"), F.length(F.get(g["gaps"], at)).alias("gap"),
            F.right(F.get(g["gaps"], at), F.lit(BEFORE)).alias("before"), F.left(F.get(g["gaps"], at + 1), F.lit(AFTER)).alias("after"),
        )))[0]
        return F.when(tried, listed).otherwise(F.array().cast("array<struct<kind:string,wide:boolean,at:int,found:string,gap:int,before:string,after:string>>"))

    every = F.concat(*[pattern(kind, wide) for wide in (False, True) for kind in KINDS])
    rows = rows.select("row", "doc_id", F.explode_outer(every).alias("c")).select("row", "doc_id", "c.*")
    # a match ends where the gaps and matches up to it end; one exchange by row serves this and all that follows
    upto = Window.partitionBy("row", "kind", "wide").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.repartition(F.col("row")).withColumn("end", F.sum(F.col("gap") + F.length("found")).over(upto))
    return placed.select("row", "doc_id", "kind", "wide", (F.col("end") - F.length("found")).alias("start"), "end", "found", "before", "after")


def _digits() -> Column:
    return F.regexp_replace("found", r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    twice = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


def octets_fit(text: Column) -> Column:
    parts = F.filter(F.split(text, r"[^0-9]+"), lambda p: p != "")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(0)) <= 255)


def base_fits() -> Column:
    """Does a base match pass its kind's check?"""
    n = F.length(_digits())
    return (
        F.when(F.col("kind") == "ip", octets_fit(F.col("found")))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn(_digits())).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(F.col("kind").isNotNull())
    )


def features() -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    digits = _digits()
    short = F.left(digits, F.lit(32))
    groups = F.filter(F.split("found", r"[^0-9]+"), lambda p: p != "")
    sizes = F.transform(groups, lambda p: F.length(p))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "length": F.length("found").cast("double"),
        "digits": F.length(digits).cast("double"),
        "groups": F.size(groups).cast("double"),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
        "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)).cast("double"),
        "checksum": one(F.length(digits).between(12, 19) & luhn(short)),
        "octets": one(octets_fit(F.left("found", F.lit(64)))),
        "plus": one(F.startswith("found", F.lit("+")) | F.startswith("found", F.lit("00"))),
        "brackets": one(F.contains("found", F.lit("("))),
        "at_sign": one(F.col("found").rlike(r"@|[(\[{]at[)\]}]")),
        "ending": F.length(F.regexp_extract("found", r"([A-Za-z]*)$", 1)).cast("double"),
        "spaces": (F.length("found") - F.length(F.replace(F.col("found"), F.lit(" ")))).cast("double"),
        "spaced_dot": one(F.col("found").rlike(r"[A-Za-z0-9]\. ")),
        "glued_before": one(F.col("before").rlike(r"[\p{L}\p{N}_#=/.-]$")),
        "glued_after": one(F.col("after").rlike(r"^[\p{L}\p{N}_=/-]")),
    }
    for kind in KINDS:
        made[f"is_{kind}"] = one(F.col("kind") == kind)
        made[f"near_{kind}"] = one(F.col("before").rlike(CONTEXT[kind]))
    return made


@dataclass
class CandidateModel:
    """Boosted trees and, per kind, the score from which on a candidate is accepted (absent: never).

    ``held_out`` has per kind the precision and recall over planted spellings of values that neither the trees nor the
    thresholds saw, and how many of these spellings are right ones (precision is None where nothing is accepted).
    """

    trees: object | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    held_out: dict[str, tuple[float | None, float, int]] = field(default_factory=dict)


#: Ways to respell a value: fixed values.
AT = [" [at] ", "[at]", " (at) ", "(at)", "{at}", " (@) "]
DOT = [".", " [dot] ", "[dot]", "(dot)", ".", " (dot) "]
IP_DOT = ["[.]", "(.)", "[dot]", " . "]
CARD_GAP = [".", "/", "_", " - ", "--"]


def respelled(values: DataFrame) -> DataFrame:
    """Wide spellings with known outcome, planted into the context of base matches: kind, found, before, after, hit, value.

    ``values`` are base matches (kind, found, before, after, fits).  Right ones: addresses with the at and the dots in
    words or brackets, octets apart, card digits in other groups, phone numbers with 00 or without their country code.
    Wrong ones: values that fail their check in the same spellings, a card with its last digit changed, an octet too
    large, "(at)" within prose, addresses and digits in groups of three taken for phone numbers.  Only spellings that the
    kind's wide generator finds whole are returned.
    """
    found, digits = F.col("found"), _digits()
    local, domain = F.substring_index("found", "@", 1), F.substring_index("found", "@", -1)
    word = lambda text, pattern: F.regexp_extract(text, pattern, 1)
    last, first = word(F.col("before"), r"([A-Za-z]{2,20})[^A-Za-z]*$"), word(F.col("after"), r"^[^A-Za-z]*([A-Za-z]{2,20})")
    second = word(F.col("after"), r"^[^A-Za-z]*[A-Za-z]+[^A-Za-z]+([A-Za-z]{2,20})")
    groups = lambda sep, size: F.regexp_replace(digits, f"([0-9]{{{size}}})(?=[0-9])", f"$1{sep}")
    wrong = F.concat(F.left(digits, F.length(digits) - 1), ((F.right(digits, F.lit(1)).try_cast("int") + 1) % 10).cast("string"))
    # a changed digit mends one failing value in ten
    mended = F.length(wrong).between(12, 19) & luhn(F.left(wrong, F.lit(32)))
    regrouped = lambda text, sep: F.regexp_replace(text, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    national = F.regexp_extract("found", r"^\+[0-9]+[ .-]*(.*)$", 1)
    large = F.concat(F.substring_index("found", ".", 3), F.lit("."), F.pmod(F.xxhash64("found"), F.lit(700)) + 300)
    as_it_is, never = F.col("fits"), F.lit(False)

    def each(made: list[tuple[str, Column, Column]]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("kind"), text.alias("found"), hit.alias("hit")) for k, text, hit in made])

    threes = F.left(digits, F.lit(9))
    three = [("phone", F.regexp_replace(threes, "([0-9]{3})(?=[0-9])", f"$1{sep}"), never) for sep in (".", " ", "-")]
    ways = {
        "email": [("email", F.concat(local, F.lit(a), F.replace(domain, F.lit("."), F.lit(d))), F.lit(True)) for a, d in zip(AT, DOT)]
        # digits tell neither an address nor prose
        + [("email", F.regexp_replace(F.concat(local, F.lit(a), F.replace(domain, F.lit("."), F.lit(d))), "[0-9]", ""), F.lit(True)) for a, d in zip(AT, DOT)]
        + [("email", F.concat(last, F.lit(a), mid, F.lit(". "), second), never) for a in (" (at) ", " [at] ") for mid in (first, F.lit("10"))],
        "ip": [("ip", F.replace(text, F.lit("."), F.lit(d)), hit) for d in IP_DOT for text, hit in ((found, as_it_is), (large, never))] + [("phone", found, never)],
        "card": [("card", text, hit) for sep in CARD_GAP for text, hit in ((groups(sep, 4), as_it_is), (regrouped(wrong, sep), mended))] + three,
        "phone": [("phone", text, as_it_is) for text in (F.concat(F.lit("00"), F.substr("found", F.lit(2))), national, F.regexp_replace(national, "[()]", ""), F.regexp_replace(F.regexp_replace(national, "[()]", ""), "[ -]", "."))],
    }
    made = F.array().cast("array<struct<kind:string,found:string,hit:boolean>>")
    for kind, list_ in ways.items():
        made = F.when(F.col("kind") == kind, each(list_)).otherwise(made)
    rows = values.select(F.xxhash64("found").alias("value"), "before", "after", F.explode(made).alias("_m")).select("value", "before", "after", "_m.*")
    whole = F.lit(False)
    for kind in KINDS:
        whole = F.when(F.col("kind") == kind, F.regexp_extract("found", rf"^(?:{WIDE[kind]})$", 0) != "").otherwise(whole)
    return rows.where(whole)


def _calibrated(scores: list[tuple[float, float]], precision: float) -> float | None:
    """Smallest score whose isotonic (pool adjacent violators) chance of a hit reaches ``precision``."""
    blocks: list[list[float]] = []  # lowest score, hits, rows
    for score, hit in sorted(scores):
        if blocks and blocks[-1][3] == score:
            blocks[-1][1] += hit
            blocks[-1][2] += 1
        else:
            blocks.append([score, hit, 1, score])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            low = blocks.pop()
            blocks[-1][1] += low[1]
            blocks[-1][2] += low[2]
            blocks[-1][3] = low[3]
    return next((b[0] for b in blocks if b[1] / b[2] >= precision), None)


def fit_candidates(found: DataFrame, max_candidates: int = MAX_CANDIDATES, precision: float = PRECISION, rounds: int = 12, depth: int = 4, seed: int = 5) -> CandidateModel:
    """Fit on planted wide spellings of base matches (see :func:`respelled`), and on the base matches themselves.

    Per kind and outcome ``max_candidates // 64`` base matches, picked by a hash, are respelled; as many base matches as
    that are used as they are.  A value's spellings stay together: half of the values grow the
    trees, a quarter sets each kind's threshold, and the last quarter measures precision and recall, which the model
    carries.  A kind without a right spelling in the second part is never accepted.  Without both outcomes there is
    nothing to learn and the model accepts no candidate.
    """
    made = features()
    known = found.where("kind is not null and not wide").select("kind", "found", "before", "after", base_fits().alias("fits"))
    # equal matches in equal places count once
    first = F.row_number().over(Window.partitionBy("kind", "fits").orderBy(F.xxhash64("kind", "found", "before", "after"), "found", "before", "after"))
    values = staged(known.distinct().withColumn("_nth", first).where(F.col("_nth") <= max(1, max_candidates // 64)).drop("_nth"), "values")
    planted = respelled(values).select("value", "kind", "found", "before", "after", F.col("hit").cast("double").alias("hit"), F.lit(True).alias("planted"))
    plain = values.select(F.xxhash64("found").alias("value"), "kind", "found", "before", "after", F.col("fits").cast("double").alias("hit"), F.lit(False).alias("planted"))
    sample = planted.unionByName(plain).select("value", "kind", "hit", "planted", *[c.alias(n) for n, c in made.items()])
    sample = VectorAssembler(inputCols=list(made), outputCol="features").transform(sample)
    sample = staged(sample.select("kind", "hit", "planted", "features", F.pmod(F.xxhash64("value"), F.lit(4)).alias("part")), "sample")
    grow, rest = sample.where("part < 2"), sample.where("part >= 2 and planted")
    if grow.select("hit").distinct().count() < 2:
        return CandidateModel()
    trees = GBTClassifier(labelCol="hit", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, checkpointInterval=-1).fit(grow.coalesce(2))
    # bounded like the sample
    scored = trees.transform(rest).select("kind", "hit", "part", vector_to_array("probability")[1].alias("p")).collect()
    every = [(r["kind"], r["p"], r["hit"]) for r in scored if r["part"] == 2]
    # a kind that never misses says nothing about where misses begin: there all kinds together do
    missed, right = ({kind for kind, _, hit in every if hit == wanted} for wanted in (0.0, 1.0))
    thresholds = {}
    for kind in right:
        scores = [(p, hit) for k, p, hit in every if k == kind or kind not in missed]
        least = _calibrated(scores, precision)
        if least is not None:
            # halfway down to the next score, which falls short; below an even chance nothing is accepted
            thresholds[kind] = max(0.5, (least + max((p for p, _ in scores if p < least), default=0.0)) / 2)
    held_out = {}
    for kind in KINDS:
        tried = [(r["p"] >= thresholds[kind] if kind in thresholds else False, r["hit"]) for r in scored if r["part"] == 3 and r["kind"] == kind]
        hits, taken = [ok for ok, hit in tried if hit], [hit for ok, hit in tried if ok]
        if hits:
            held_out[kind] = (sum(taken) / len(taken) if taken else None, sum(hits) / len(hits), len(hits))
    return CandidateModel(trees, thresholds, held_out)


def personal_spans(docs: DataFrame, model: CandidateModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (start, rank, end, kind, base, score), in the order of start and kind.

    Base matches that pass their check always are spans.  Candidates of the wide generators become spans if the trees'
    score reaches their kind's threshold and they overlap no base span and no accepted candidate before them.  Without a
    ``model`` one is fitted on this table.  Null and empty texts have no spans; repeated rows give repeated rows; an empty
    table gives an empty result; other columns are ignored.
    """
    found = staged(candidates(docs, id_col, text_col), "candidates")
    model = fit_candidates(found) if model is None else model
    rank = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1).when(F.col("kind") == KINDS[2], 2).otherwise(3)
    marked = found.withColumn("rank", rank).withColumn("base", ~F.col("wide") & base_fits())
    names = marked.columns
    plain = marked.where("not wide or kind is null").select(*names, F.lit(1.0).alias("score"), F.coalesce("base", F.lit(False)).alias("taken"))
    wide = marked.where("wide")
    if model.trees is not None and model.thresholds:
        made = features()
        scored = model.trees.transform(VectorAssembler(inputCols=list(made), outputCol="features").transform(wide.withColumns(made)))
        least = F.lit(None).cast("double")
        for kind, limit in model.thresholds.items():
            least = F.when(F.col("kind") == kind, F.lit(limit)).otherwise(least)
        score = vector_to_array("probability")[1]
        wide = scored.select(*names, score.alias("score"), F.coalesce(score >= least, F.lit(False)).alias("taken"))
    else:
        wide = wide.select(*names, F.lit(0.0).alias("score"), F.lit(False).alias("taken"))
    some = plain.unionByName(wide)
    # a candidate that is not taken goes, but its row stays
    some = some.withColumns({c: F.when(F.col("taken"), F.col(c)) for c in ("kind", "start", "end", "wide")}).repartition(F.col("row"))
    order = Window.partitionBy("row").orderBy("start", F.col("wide").cast("int"), "rank")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    ended = F.coalesce(F.max("end").over(earlier), F.lit(-1))
    next_base = F.coalesce(F.min(F.when(~F.col("wide"), F.col("start"))).over(later), F.lit(1 << 40))
    clear = ~F.coalesce("wide", F.lit(False)) | ((ended <= F.col("start")) & (next_base >= F.col("end")))
    some = some.withColumn("clear", clear)
    span = F.when(F.col("clear") & F.col("kind").isNotNull(), F.struct("start", "rank", "end", "kind", "base", "score"))
    return some.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def redact(docs: DataFrame, model: CandidateModel | None = None, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; ``id_col`` must tell the rows apart."""
    spans = personal_spans(docs, model, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id")
    # from the last span to the first, so that places stay right
    flat = F.filter("spans", lambda s: s["start"].isNotNull())
    put = lambda text, s: F.concat(F.left(text, s["start"].cast("int")), F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1]), F.substr(text, s["end"].cast("int") + 1))
    return rows.select("doc_id", F.aggregate(F.reverse(flat), F.col("text"), put).alias("text"))


def pii_digest(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    told = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans.select("doc_id", *[count(kind) for kind in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
