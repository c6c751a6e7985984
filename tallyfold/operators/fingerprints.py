"""Fixed-length fingerprints of strings, as sorted arrays of set-bit positions.

All built-in fingerprints are projections: no shuffle, no Python, one output row per input row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.hashing import fold_distinct
from tallyfold.functions.scalars import let
from tallyfold.operators.labels import encode_category

# ASCII white space only, so that every engine cuts words alike.
WORD_GAP = r"[ \t\r\n]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda t: t != "")


def token_chain_bits(df: DataFrame, text: str, radius: int, n_bits: int, name: str = "bits", hash: str = "md5") -> DataFrame:
    """Circular fingerprint of a word chain.

    For every word and every k = 0..radius the words up to k places away on both sides, joined by a
    space, are hashed as ``k:words`` and folded.  The neighbourhood of radius k grows from the one of
    radius k - 1, so each word costs radius + 1 hashes.
    """
    return df.withColumn(name, token_chain(F.col(text), radius, n_bits, hash))


def token_chain(text: Column, radius: int, n_bits: int, hash: str = "md5") -> Column:
    def named(near: Column, k: int) -> Column:
        return F.transform(near, lambda w: F.concat(F.lit(f"{k}:"), w))

    def rounds_from(tokens: Column, near: Column, k: int) -> Column:
        """Texts of rounds k..radius, given the neighbourhoods of round k."""
        if k == radius:
            return named(near, k)
        step = F.lit(k + 1)
        wider = F.transform(near, lambda w, i: F.concat_ws(" ", F.get(tokens, i - step), w, F.get(tokens, i + step)))
        return F.concat(named(near, k), let(wider, lambda w: rounds_from(tokens, w, k + 1)))

    return fold_distinct(let(words(text), lambda t: rounds_from(t, t, 0)), n_bits, hash)


@dataclass(frozen=True)
class PatternKey:
    """Bit ``key`` is set when ``pattern`` occurs at least ``min_count`` times."""

    key: int
    pattern: str
    min_count: int = 1


# Structural keys of line-notation strings. Patterns stay in the subset that Java and RE2 share.
NOTATION_KEYS = (
    PatternKey(0, r"Br"),
    PatternKey(1, r"Cl"),
    PatternKey(2, r"F"),
    PatternKey(3, r"F", 3),
    PatternKey(4, r"I"),
    PatternKey(5, r"S|s"),
    PatternKey(6, r"P"),
    PatternKey(7, r"B([^r]|$)"),
    PatternKey(8, r"N|n"),
    PatternKey(9, r"N|n", 2),
    PatternKey(10, r"N|n", 4),
    PatternKey(11, r"O|o"),
    PatternKey(12, r"O|o", 2),
    PatternKey(13, r"O|o", 4),
    PatternKey(14, r"="),
    PatternKey(15, r"=", 2),
    PatternKey(16, r"#"),
    PatternKey(17, r"C\(=O\)"),
    PatternKey(18, r"C\(=O\)", 2),
    PatternKey(19, r"C\(=O\)N"),
    PatternKey(20, r"C\(=O\)O"),
    PatternKey(21, r"S\(=O\)\(=O\)"),
    PatternKey(22, r"c"),
    PatternKey(23, r"c", 6),
    PatternKey(24, r"c", 12),
    PatternKey(25, r"n"),
    PatternKey(26, r"\[nH\]"),
    PatternKey(27, r"o"),
    PatternKey(28, r"s"),
    PatternKey(29, r"1"),
    PatternKey(30, r"2"),
    PatternKey(31, r"%[0-9][0-9]"),
    PatternKey(32, r"\("),
    PatternKey(33, r"\(", 3),
    PatternKey(34, r"@"),
    PatternKey(35, r"\+"),
    PatternKey(36, r"-\]"),
    PatternKey(37, r"\."),
    PatternKey(38, r"[/\\]"),
    PatternKey(39, r"[0-9]", 4),
)

# Structural keys of prose and markup.
PROSE_KEYS = (
    PatternKey(0, r"[0-9]"),
    PatternKey(1, r"[0-9]", 10),
    PatternKey(2, r"[0-9]{4}"),
    PatternKey(3, r"[A-Z]"),
    PatternKey(4, r"[A-Z]", 20),
    PatternKey(5, r"[A-Z][A-Z]+"),
    PatternKey(6, r"[.]", 5),
    PatternKey(7, r"[.]", 50),
    PatternKey(8, r"[,;:]", 10),
    PatternKey(9, r"[!?]"),
    PatternKey(10, r"\n"),
    PatternKey(11, r"\n", 10),
    PatternKey(12, r"\n\n"),
    PatternKey(13, r"https?://"),
    PatternKey(14, r"[a-z0-9._]+@[a-z0-9.]+"),
    PatternKey(15, r"<[a-z]+"),
    PatternKey(16, r"<p>", 3),
    PatternKey(17, r"[{}]"),
    PatternKey(18, r"[*#%]"),
    PatternKey(19, r" (the|and|of) ", 3),
    PatternKey(20, r" (der|die|und) ", 3),
    PatternKey(21, r" (el|los|que) ", 3),
    PatternKey(22, r" (le|les|des) ", 3),
    PatternKey(23, r" ", 1000),
)


def pattern_key_bits(df: DataFrame, text: str, keys: Sequence[PatternKey], name: str = "bits") -> DataFrame:
    """Structural-key fingerprint: one projection of counted patterns."""
    source = F.coalesce(F.col(text), F.lit(""))

    def found(k: PatternKey) -> Column:
        # a search stops at the first match, a count reads on
        return source.rlike(k.pattern) if k.min_count == 1 else F.regexp_count(source, F.lit(k.pattern)) >= k.min_count

    hits = [F.when(found(k), F.lit(k.key)) for k in sorted(keys, key=lambda k: k.key)]
    return df.withColumn(name, F.array_compact(F.array(*hits)).cast("array<int>"))


def user_kernel_bits(
    df: DataFrame, text: str, kernel: Callable, name: str = "bits", whole_batch: bool = False
) -> DataFrame:
    """Fingerprint by a user function ``string -> set-bit positions`` that runs on the executors.

    Use this to plug in a library installed there, such as a chemistry toolkit.  Strings travel in
    Arrow batches; with ``whole_batch`` the function gets such a batch as one series, nulls included, and
    returns a series of sorted position lists.
    """

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        if whole_batch:
            return kernel(texts)
        return texts.map(lambda s: None if s is None else sorted({int(b) for b in kernel(s)}))

    return df.withColumn(name, run(F.col(text)))


# ------------------------------------------------------------------------------------- to features


def with_category_code(df: DataFrame, category: str, dictionary: DataFrame, name: str = "code", n_codes: int | None = None) -> DataFrame:
    """Integer code of a category from a (grown) dictionary of ``n_codes`` values, if that is known."""
    return encode_category(df, category, dictionary, name, n_codes)


def bits_to_vector(df: DataFrame, bits: str, n_bits: int, name: str = "features") -> DataFrame:
    """Sparse 0/1 vector of ``n_bits``, built in the JVM with position i at index i."""
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], inputCol="_s", outputCol=name)
    spelled = df.withColumn("_s", F.col(bits).cast("array<string>"))
    return model.setBinary(True).transform(spelled).drop("_s")


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """One vector out of vectors and numbers, in the given order; a null is an error when run."""
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="error").transform(df)


# ---------------------------------------------------------------------------------------- dispatch

Featurizer = Callable[..., DataFrame]


def _circular(df: DataFrame, text: str, radius: int = 2, length: int = 2048, hash: str = "md5", **_) -> DataFrame:
    return token_chain_bits(df, text, radius, length, hash=hash)


def _pattern_keys(df: DataFrame, text: str, keys: Sequence[PatternKey] = NOTATION_KEYS, **_) -> DataFrame:
    return pattern_key_bits(df, text, keys)


def _graph_circular(df: DataFrame, text: str, radius: int = 2, length: int = 2048, hash: str = "md5", **_) -> DataFrame:
    from tallyfold.operators.graphs import notation_bits

    # null bits tell which texts cannot be read; the job counts them and stops
    return notation_bits(df, text, radius, length, hash=hash, bad="null")


def _structure_keys(df: DataFrame, text: str, **_) -> DataFrame:
    from tallyfold.operators.structure import structure_key_bits

    return structure_key_bits(df, text)


FEATURIZERS: dict[str, Featurizer] = {
    "structure_keys": _structure_keys,
    "token_chain": _circular,
    "graph_circular": _graph_circular,
    "pattern_keys": _pattern_keys,
}


def register_featurizer(name: str, run: Featurizer) -> None:
    """Add a fingerprint of your own: ``run(df, text, radius=, length=, hash=)`` adds an int array ``bits``."""
    FEATURIZERS[name] = run


def featurizer(name: str) -> Featurizer:
    """Fingerprint function by name: ``(df, text, **settings) -> df with a "bits" column``."""
    if name not in FEATURIZERS:
        raise NotImplementedError(f"fingerprint {name!r} is not implemented; choose one of {sorted(FEATURIZERS)}")
    return FEATURIZERS[name]
