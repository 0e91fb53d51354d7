"""Text operators. Case folding and white space are ASCII's; tokens are arrays of strings without empty ones."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import GraphError
from .kernels import kernel, sparse_map
from .registry import Context, Value, operator, sparse

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r"[ \t\n\x0B\f\r]"


def _strings(ins: list[Value]) -> list[Column]:
    if any(v.kind != "string" for v in ins):
        raise GraphError("strings are needed")
    return [c for v in ins for c in v.cols]


def _tokens(ins: list[Value]) -> Column:
    if not ins or ins[0].kind != "tokens":
        raise GraphError("tokens are needed")
    return ins[0].cols[0]


def ascii_lower(c: Column) -> Column:
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def _each(ins: list[Value], f) -> Value:
    if ins and ins[0].kind == "tokens":
        return Value([F.transform(ins[0].cols[0], f)], "tokens")
    return Value([f(c) for c in _strings(ins)], "string")


@operator("text", "Lowercase")
def lowercase(ins: list[Value], ctx: Context):
    return _each(ins, ascii_lower)


@operator("text", "Trim")
def trim(ins: list[Value], ctx: Context):
    return _each(ins, lambda c: F.btrim(c, F.lit(" \t\n\x0b\f\r")))


@operator("text", "NormalizeWhitespace")
def normalize_whitespace(ins: list[Value], ctx: Context):
    """Runs of white space become one space, also at the ends."""
    return _each(ins, lambda c: F.regexp_replace(c, _SPACE + "+", " "))


@operator("text", "StringReplace")
def string_replace(ins: list[Value], ctx: Context):
    old, new = str(ctx.get("old", "")), str(ctx.get("new", ""))
    if not old:
        return _each(ins, lambda c: c)
    if ctx.get("replace_all", True):
        return _each(ins, lambda c: F.replace(c, F.lit(old), F.lit(new)))

    def first(c: Column) -> Column:
        at = F.locate(old, c)
        return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)

    return _each(ins, first)


def _java(pattern: object) -> str:
    if not pattern:
        raise GraphError("a pattern is required")
    try:
        re.compile(str(pattern))
    except re.error as e:
        raise GraphError(f"bad pattern {pattern}: {e}") from e
    return str(pattern)


@operator("text", "RegexReplace")
def regex_replace(ins: list[Value], ctx: Context):
    """All matches. In the replacement $1 is a group and $& the match."""
    pattern, new = _java(ctx.get("pattern")), str(ctx.get("replacement", "")).replace("$&", "$0")
    return _each(ins, lambda c: F.regexp_replace(c, pattern, new))


def _some(c: Column) -> Column:
    return F.filter(c, lambda t: t != "")


@operator("text", "Tokenizer")
def tokenizer(ins: list[Value], ctx: Context):
    return Value([_some(F.split(ascii_lower(_strings(ins)[0]), _SPACE + "+", -1))], "tokens")


@operator("text", "RegexTokenizer")
def regex_tokenizer(ins: list[Value], ctx: Context):
    """Lower-cased; what stands between matches, or with gaps false the matches; of min_token_length bytes at least."""
    text, pattern = ascii_lower(_strings(ins)[0]), _java(ctx.get("pattern", r"\s+"))
    found = F.split(text, pattern, -1) if ctx.get("gaps", True) else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    least = max(1, int(ctx.get("min_token_length", 1)))
    return Value([F.filter(found, lambda t: F.octet_length(t) >= least)], "tokens")


@operator("text", "NGram")
def ngram(ins: list[Value], ctx: Context):
    """Runs of n_min to n_max tokens, joined by a space; by n, then by place."""
    tokens, parts = _tokens(ins), []
    for n in range(int(ctx.get("n_min", 2)), int(ctx.get("n_max", 2)) + 1):
        # each step joins the next token to all grams at once; nothing in a lambda reads the whole list
        count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        grams = F.slice(tokens, F.lit(1), count)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(tokens, F.lit(k + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grams)
    return Value([F.concat(*parts)], "tokens")


@operator("text", "StopWordsRemover")
def stop_words_remover(ins: list[Value], ctx: Context):
    words, exact = [str(w) for w in ctx.get("stop_words") or []], ctx.get("case_sensitive", False)
    if not exact:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    fold = (lambda t: t) if exact else ascii_lower
    tokens = _some(_tokens(ins))
    return Value([F.filter(tokens, lambda t: ~fold(t).isin(words)) if words else tokens], "tokens")


def _by_place(words: list[str]) -> dict[str, int]:
    """A repeated word stands at its last place."""
    return {w: i for i, w in enumerate(words)}


#: Vocabularies of up to so many words are counted by expressions, one pass a word.
FEW_WORDS = 16


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The row and the code of each token that is there, row by row, and the distinct tokens by code."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    rows, tokens = np.repeat(np.arange(len(column)), sizes), column.flatten().dictionary_encode()
    there = tokens.indices.is_valid().to_numpy(zero_copy_only=False)
    return rows[there], tokens.indices.fill_null(0).to_numpy(zero_copy_only=False)[there].astype(np.int64), tokens.dictionary.to_pylist()


@operator("text", "CountVectorizer")
def count_vectorizer(ins: list[Value], ctx: Context):
    """Counts of the vocabulary's words; with binary 1 for each that occurs."""
    words = list(ctx.need("vocabulary"))
    place, tokens, binary = _by_place(words), _tokens(ins), ctx.get("binary", False)
    if len(words) <= FEW_WORDS:
        count = lambda w: F.size(F.filter(tokens, lambda t: t == w)).cast("double")
        out = [count(w) if place[w] == i else F.lit(0.0) for i, w in enumerate(words)]
        return [F.least(c, F.lit(1.0)) for c in out] if binary else out

    def run(column: pa.Array) -> np.ndarray:
        rows, codes, distinct = _coded(column)
        at = np.array([place.get(t, -1) for t in distinct], dtype=np.int64)[codes]
        cells = (rows * len(words) + at)[at >= 0]
        out = np.bincount(cells, minlength=len(column) * len(words)).reshape(len(column), len(words))
        return np.minimum(out, 1) if binary else out

    return kernel(ctx.spark, run, [tokens], len(words), arrays=True)


#: Fixed values of murmur3_x86_32: the multipliers of a block, the addend of a round, the multipliers of the end.
BLOCK_1, BLOCK_2, ROUND, LAST_1, LAST_2 = map(np.uint32, (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35))


def murmur3(tokens: list[str], seed: int = 42) -> np.ndarray:
    """murmur3_x86_32 of the tokens' UTF-8, signed: all tokens at once, block by block, the longest to the end."""
    data = [t.encode("utf-8") for t in tokens]
    size = np.array([len(d) for d in data], dtype=np.int64)
    text = np.frombuffer(b"".join(data) + bytes(4), dtype=np.uint8).astype(np.uint32)
    start, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
    left = np.cumsum(np.bincount(size // 4)[::-1])[::-1] if len(data) else []
    h = np.full(len(data), seed, dtype=np.uint32)

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint32(n) | x >> np.uint32(32 - n)

    def read(at: np.ndarray, bytes_: np.ndarray | int) -> np.ndarray:
        block = sum(np.where(bytes_ > k, text[np.minimum(at + k, len(text) - 1)], np.uint32(0)) << np.uint32(8 * k) for k in range(4))
        return turned(block * BLOCK_1, 15) * BLOCK_2

    for block in range(len(left) - 1):
        on = order[: left[block + 1]]
        h[on] = turned(h[on] ^ read(start[on] + 4 * block, 4), 13) * np.uint32(5) + ROUND
    h ^= read(start + size // 4 * 4, size % 4) ^ size.astype(np.uint32)
    for shift, factor in ((16, LAST_1), (13, LAST_2)):
        h = (h ^ h >> np.uint32(shift)) * factor
    return (h ^ h >> np.uint32(16)).astype(np.int32).astype(np.int64)


@operator("text", "HashingVectorizer")
def hashing_vectorizer(ins: list[Value], ctx: Context):
    """Counts by murmur3 of the tokens, modulo num_features; with alternate_sign a negative hash counts down.

    Up to 4096 features are dense columns; more are a sparse value, one map of
    index to value, which TfIdfTransformer, Normalizer, TruncatedSVD, linear
    models and multinomial naive Bayes read, and which a graph may return.
    """
    n, binary, signed = int(ctx.get("num_features", 1 << 18)), ctx.get("binary", False), ctx.get("alternate_sign", False)

    def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places (row times num_features plus index), sorted, and their values. Each distinct token of a batch is hashed once."""
        rows, codes, distinct = _coded(column)
        hashes = murmur3(distinct)
        step = np.where(signed & (hashes < 0), -1.0, 1.0)[codes]
        at = rows * n + (hashes % n)[codes]
        places, inverse = np.unique(at, return_inverse=True)
        if binary:  # the last token decides
            out = np.empty(len(places))
            out[inverse] = step
            return places, out
        return places, np.bincount(inverse, weights=step, minlength=len(places))

    if n <= 4096:

        def run(column: pa.Array) -> np.ndarray:
            out = np.zeros(len(column) * n)
            places, values = cells(column)
            out[places] = values
            return out.reshape(len(column), n)

        return kernel(ctx.spark, run, [_some(_tokens(ins))], n, arrays=True)

    @F.arrow_udf("map<int,double>")
    def hashed(column: pa.Array) -> pa.Array:
        places, values = cells(column)
        ends = np.searchsorted(places, np.arange(len(column) + 1) * n).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(ends), pa.array((places % n).astype(np.int32)), pa.array(values))

    return Value([hashed(_some(_tokens(ins)))], "map", size=n)


@operator("text", "TfIdfTransformer")
def tf_idf_transformer(ins: list[Value], ctx: Context):
    if wide := sparse(ins):
        idf = np.array(ctx.numbers("idf", wide.size, 1.0), dtype=float)
        return sparse_map(wide, lambda n, rows, at, x: x * idf[at])
    cols = [c for v in ins for c in v.cols]
    return [c * w for c, w in zip(cols, ctx.numbers("idf", len(cols), 1.0))]


@operator("text", "Word2Vec")
def word2vec(ins: list[Value], ctx: Context):
    """Mean vector of the tokens in the vocabulary; zeros if there is none."""
    place = _by_place(list(ctx.need("vocabulary")))
    vectors = np.asarray(ctx.need("vectors"), dtype=float).reshape(len(ctx.need("vocabulary")), -1)

    def run(column: pa.Array) -> np.ndarray:
        rows, codes, distinct = _coded(column)
        at = np.array([place.get(t, -1) for t in distinct], dtype=np.int64)[codes]
        rows, at = rows[at >= 0], at[at >= 0]
        out = np.zeros((len(column), vectors.shape[1]))
        held, first, sizes = np.unique(rows, return_index=True, return_counts=True)
        if len(held):
            out[held] = np.add.reduceat(vectors[at], first, axis=0) / sizes[:, None]
        return out

    return kernel(ctx.spark, run, [_some(_tokens(ins))], vectors.shape[1], arrays=True)
