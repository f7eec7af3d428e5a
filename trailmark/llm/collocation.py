"""Phrase collocation mining on a prefix-free parse.

A text is a run of tokens: words, and one break between pieces. Where the hash of `longest - 1` tokens in a row hits a trigger,
a chunk begins; it goes on over the `longest - 1` tokens that begin the next chunk. So the same passage gives the same chunks
wherever it stands, chunks overlap by a trigger, and each phrase of up to `longest` words lies whole in the chunk in which
it starts before the overlap. The distinct chunks and how often the parse has each take the place of the texts: phrases are
counted in each distinct chunk once, by the chunk's frequency, and only those that start before its overlap.

A phrase is frequent only if all its words and pairs are. Words are counted first, then pairs of frequent words, then
phrases all of whose pairs are frequent. Words and pairs pass through hashed filters, which can only let more through: what is
reported has been counted by its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm._arrow import byte_view, cut, map_arrow, map_texts, release, written_table
from trailmark.llm._gather import bit_filter, filter_bits, passes
from trailmark.llm._words import mix

#: A trigger is hit by one in so many token windows (a power of two). A chunk without triggers ends after LONGEST_CHUNK tokens.
SPACING, LONGEST_CHUNK = 64, 1024
#: Languages whose word totals are broadcast.
MOST_LANGUAGES = 10_000
#: Bytes of chunks counted together in a task.
SLICE_BYTES = 4 << 20
#: Spark's seed of xxhash64, which hashes words in tasks as xxhash64(lang, word) does in plans.
_SEED = 42
_U = np.uint64
_FACTORS = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(16)]
BREAK = "."

_token = np.arange(256, dtype=np.uint8)
_token[65:91] += 32
_token[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = ord(BREAK)
_token[9] = 32


def token_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word number) of every token of a text_array, and the words; number 0 is the break, given once for a run of marks."""
    raw, at = byte_view(texts)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(_token[raw].tobytes())])
    lists = pc.split_pattern(pc.replace_substring(plain, BREAK, f" {BREAK} "), " ")
    flat, row = lists.flatten(), np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    full = pc.greater(pc.binary_length(flat), 0)
    flat, row = flat.filter(full), row[np.asarray(full)]
    number, words = numbered(flat)
    again = np.zeros(len(row), bool)
    again[1:] = (number[1:] == 0) & (number[:-1] == 0) & (row[1:] == row[:-1])
    return row[~again], number[~again], words


def numbered(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of tokens and the token of each number; the break has number 0."""
    coded = flat.dictionary_encode()
    own = np.asarray(pc.equal(coded.dictionary, BREAK))
    number = np.where(own, 0, np.cumsum(~own))
    words = pa.concat_arrays([pa.array([BREAK], flat.type), coded.dictionary.filter(pa.array(~own))])
    return (number[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64)), words


def word_hashes(words: pa.Array, seed: int = _SEED) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), _U, len(words))


def chunk_starts(row: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the tokens that begin a chunk. hashes: of each token."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.ones(n, bool)
    begin[1:] = row[1:] != row[:-1]
    inside = n - width + 1
    if inside > 0:
        window = sum((hashes[k : k + inside] * _FACTORS[k] for k in range(1, width)), hashes[:inside] * _FACTORS[0])
        begin[:inside] |= (mix(window) & _U(SPACING - 1) == 0) & (row[:inside] == row[width - 1 :])
    at = np.flatnonzero(begin)
    gap = np.diff(at, append=n)
    extra = (gap - 1) // LONGEST_CHUNK
    return np.repeat(at, extra + 1) + LONGEST_CHUNK * (np.arange((extra + 1).sum()) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))


def parse(texts: pa.Array, longest: int) -> tuple[np.ndarray, pa.Array]:
    """(text, chunk) of the prefix-free parse: tokens with a blank between, the last `longest - 1` of which begin the next
    chunk or, at a text's end, are breaks."""
    row, number, words = token_table(texts)
    width = longest - 1
    start = chunk_starts(row, word_hashes(words)[number], width)
    own = np.diff(start, append=len(row))
    n = own + width
    token = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    end = np.cumsum(np.bincount(row, minlength=len(texts)))
    past = token >= np.repeat(end[row[start]], n)
    number = np.where(past, 0, number[np.minimum(token, len(number) - 1)]) if len(number) else number
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int64()), words.take(pa.array(number)))
    return row[start], pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def parsed(docs: DataFrame, text_col: str, lang_col: str, longest: int) -> DataFrame:
    """(lang, chunk, n): the parse's dictionary with frequencies."""

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        row, chunk = parse(texts, longest)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), chunk.cast(pa.string())], names=["lang", "chunk"])

    frame = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return map_texts(frame, "text", "lang string, chunk string", step).groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("n"))


class Chunks:
    """The tokens of a slice of the dictionary. word: number of each token in `words`; lang: of each in `langs`; n: its chunk's
    frequency; own: whether phrases that start here are counted in this chunk."""

    def __init__(self, part: pa.RecordBatch, chunks: pa.Array, width: int):
        lists = pc.split_pattern(chunks, " ")
        size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        self.word, self.words = numbered(lists.flatten())
        langs = part.column(0).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = np.repeat(np.asarray(langs.indices).astype(np.int64), size)
        self.n = np.repeat(np.asarray(part.column(2)), size)
        ends = np.cumsum(size)
        self.left = np.repeat(ends, size) - np.arange(len(self.word))
        self.own = (self.left > width) & (self.word > 0)

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each token's (language, word) pair, and the pairs' hashes, as xxhash64(lang, word) gives them."""
        pair, at = np.unique(self.lang * len(self.words) + self.word, return_inverse=True)
        hashes, lang, word = np.zeros(len(pair), _U), pair // len(self.words), pair % len(self.words)
        for k, seed in enumerate(word_hashes(self.langs)):
            some = np.flatnonzero(lang == k)
            hashes[some] = word_hashes(self.words.take(pa.array(word[some])), int(seed))
        return at, hashes

    def bigrams(self, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a token and the next are two words of a piece, and the hash of both. of_word: hashes of the tokens."""
        both = np.zeros(len(self.word), bool)
        both[:-1] = (self.word[:-1] > 0) & (self.word[1:] > 0) & (self.left[:-1] > 1)
        key = np.zeros(len(self.word), _U)
        key[:-1] = mix(of_word[:-1] * _FACTORS[0] + of_word[1:] * _FACTORS[1])
        return both, key


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and the sums of n."""
    own, first, at = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, n)
    return own, first, total


def word_counts(chunks: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, n) of all words; phrase null: all words of the language together."""

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        c = Chunks(part, texts, longest - 1)
        key, first, n = _sums((c.lang * len(c.words) + c.word)[c.own], c.n[c.own])
        lang, _, total = _sums(c.lang[c.own], c.n[c.own])
        words = pa.concat_arrays([c.words.take(pa.array(key % len(c.words))).cast(pa.string()), pa.nulls(len(lang), pa.string())])
        return pa.RecordBatch.from_arrays([c.langs.take(pa.array(np.append(key // len(c.words), lang))), words, pa.array(np.append(n, total))], names=["lang", "phrase", "n"])

    return map_texts(chunks, "chunk", "lang string, phrase string, n bigint", step, limit=SLICE_BYTES).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def hash_bits(total: int) -> int:
    """Bits of a pair's hash: 4,096 values for each word of the corpus, so that few rare pairs share one with a frequent pair."""
    return min(63, max(24, total.bit_length() + 12))


def frequent_pairs(chunks: DataFrame, longest: int, words: np.ndarray, min_count: int, bits: int = 63) -> DataFrame:
    """(h) hashes of pairs of words that pass the filter `words` and occur min_count times, and of pairs that share such a hash."""
    shared = chunks.sparkSession.sparkContext.broadcast(words)

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        c = Chunks(part, texts, longest - 1)
        at, hashes = c.pair_keys()
        known = passes(shared.value, hashes)[at]
        both, key = c.bigrams(hashes[at])
        both &= c.own & known & np.append(known[1:], False)
        h, _, n = _sums(key[both] >> _U(64 - bits), c.n[both])
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = map_texts(chunks, "chunk", "h bigint, n bigint", step, limit=SLICE_BYTES).groupBy("h").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count).select("h")


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A filter of pair hashes; they are mixed first, as their upper bits are empty."""

    def spread(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(np.ascontiguousarray(batch.column(0)).view(_U)).view(np.int64))], names=["h"])

    return bit_filter(map_arrow(pairs, spread, "h bigint"), filter_bits(pairs.count()))


def phrase_counts(chunks: DataFrame, longest: int, pairs: np.ndarray, bits: int = 63) -> DataFrame:
    """(lang, phrase, n) of phrases of 2 to `longest` words all of whose pairs pass the filter."""
    shared = chunks.sparkSession.sparkContext.broadcast(pairs)

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        c = Chunks(part, texts, longest - 1)
        at, hashes = c.pair_keys()
        both, key = c.bigrams(hashes[at])
        both[both] = passes(shared.value, mix(key[both] >> _U(64 - bits)))
        # A phrase's code is the number of (the code of its words but the last, its last word), exact at each length.
        start = np.flatnonzero(both & c.own)
        code = (c.lang * len(c.words) + c.word)[start]
        out = []
        for size in range(2, longest + 1):
            code = np.unique(code, return_inverse=True)[1]
            on = both[start + size - 2]
            start, code = start[on], code[on] * len(c.words) + c.word[start[on] + size - 1]
            _, first, n = _sums(code, c.n[start])
            if not len(first):
                break
            tokens = c.words.take(pa.array(c.word[(start[first][:, None] + np.arange(size)).ravel()]))
            lists = pa.LargeListArray.from_arrays(pa.array(np.arange(len(first) + 1) * size, pa.int64()), tokens)
            out.append(pa.RecordBatch.from_arrays([c.langs.take(pa.array(c.lang[start[first]])), pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_texts(chunks, "chunk", "lang string, phrase string, n bigint", step, limit=SLICE_BYTES).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of words and phrases that occur min_count times in a language, and (lang, n) of all its words."""
    with written_table(parsed(docs, text_col, lang_col, longest)) as chunks:
        # Each step's shuffle files go before the next step makes its own.
        spark = docs.sparkSession
        release(spark)
        words = cut(word_counts(chunks, longest).where((F.col("n") >= min_count) | F.col("phrase").isNull()))
        release(spark)
        single = words.where("phrase IS NOT NULL")
        bits = hash_bits(words.where("phrase IS NULL").agg(F.sum("n")).first()[0] or 0)
        known = bit_filter(single.select(F.xxhash64("lang", "phrase")), filter_bits(single.count()))
        pairs = cut(frequent_pairs(chunks, longest, known, min_count, bits))
        release(spark)
        phrases = cut(phrase_counts(chunks, longest, pair_filter(pairs), bits).where(F.col("n") >= min_count))
    return single.unionByName(phrases).withColumnRenamed("n", "f"), words.where("phrase IS NULL").select("lang", "n")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of the phrases of two words and more by their lowest-scoring cut."""
    many = frequent.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select("lang", "phrase", "a", F.size("w").alias("size"), "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    of = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"])
    # A row a language; where they are many, none has so many of the rows that a shuffle by language is uneven.
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= MOST_LANGUAGES else totals, "lang")
    # 37 digits hold both products; a count has 15 digits at most.
    score = F.expr("(CAST(1000 * a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0))) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("size").alias("size"))
    return least.select("lang", "phrase", "size", "a", "c.l", "c.r", "n", "c.score")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """The phrases of each language whose words hold together most.

    Texts, A-Z in lower case, are split at `.,;:!?` and line ends into pieces, these at blanks and tabs into words. Phrases of 2 to `longest`
    words that occur min_count times in pieces of a language get floor(1000 a n / (l r)) of their lowest-scoring cut (ties: after
    fewer words): a, l and r are the occurrences of the phrase and of the parts before and after the cut, n all words of
    the language. Phrases that lie in a longer candidate with `percent` of their occurrences are dropped. Returns the
    first `top` of each language by score, a and the phrase's bytes: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.
    Null texts count as empty, a null language as "und"; repeated rows and rows with null ids count each; other columns are
    not read; an empty table gives no rows. Counts are exact below 10^15.
    Scale: the texts are shuffled once, as chunks (a chunk that all share is counted in the tasks first), and written once
    as distinct chunks, which three passes read; pairs are shuffled as hashes. Broadcast: two filters, 32 MB at most each, which past
    16 million keys let more through and lose nothing. The ranks' last step holds `top` rows of each task for a language.
    """
    frequent, totals = frequent_phrases(docs, text_col, lang_col, longest, min_count)
    best = scored(frequent, totals)
    # Occurrences never grow with length, so a phrase within any longer candidate is within one longer by a word as often.
    longer = frequent.select("lang", "f", F.split("phrase", " ").alias("w")).where(F.size("w") > 2)
    inner = longer.select("lang", "f", F.explode(F.array(F.array_join(F.slice("w", 1, F.size("w") - 1), " "), F.array_join(F.slice("w", 2, F.size("w") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same result in DuckDB.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, w[i : i + k - 1] AS p FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, generate_series(1, 5) AS t(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, p, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.p, c.k, c.f AS a, j, l.f AS l, r.f AS r, n, (1000 * c.f * n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM f WHERE k > 1) c JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.p = c.p[1 : j] JOIN f r ON r.lang = c.lang AND r.p = c.p[j + 1 : c.k]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), inner_parts AS (
  SELECT DISTINCT lang, p[i : i + m - 1] AS p, f FROM (
    SELECT lang, p, f, m, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM f WHERE k > 2))
), kept AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.p = b.p AND 100 * i.f >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
