"""Language identification: a linear-chain conditional random field labels the words of possibly code-switched text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import map_texts
from trailmark.llm._sample import labelled_sample, remainder

#: Hashed features.
SPACE = 1 << 16
#: Letters of a word at most. A longer run (scripts without blanks) is several words, which overlap by two letters, so that
#: none of its n-grams is lost; JOINT, which white-space splitting never leaves in a word, marks their inner ends.
PIECE, JOINT = 30, "\x1f"
#: Words of a block: blocks of a text are worked on side by side once the messages at their edges are known.
BLOCK = 256
#: Distinct words that a task remembers before it starts anew.
CACHE_WORDS = 400_000
#: Text bytes of one step of a task.
SLICE = 2 << 20
UNKNOWN = "und"
_OTHER = re.compile(rf"(?![{JOINT}])[\W\d_]")


def letters(word: str) -> str:
    """The letters of a word in lower case, other characters dropped."""
    kept = _OTHER.sub("", word)
    return kept.lower() if kept.isalpha() else "".join(c for c in kept if c.isalpha() or c == JOINT).lower()


def split_words(text: str) -> list[str]:
    """The words of a text, parted by white space; those of more than PIECE letters in pieces, which hold letters only."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for word in words:
        if len(word) <= PIECE or len(run := letters(word)) <= PIECE:
            out.append(word)
            continue
        starts = range(0, len(run) - 2, PIECE - 2)
        out += [JOINT * (at > 0) + run[at : at + PIECE] + JOINT * (at + PIECE < len(run)) for at in starts]
    return out


def _hashed(kind: int, parts: list[np.ndarray]) -> np.ndarray:
    """A feature number below SPACE for each row of code points."""
    h = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for part in parts:
        h = (h + part + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(8)).astype(np.int64) & (SPACE - 1)


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of all affixes to four letters, bigrams, trigrams and lexicon words; a piece has no affixes
    and no edge at its inner ends."""
    edged = [f"<{w}>".replace(f"<{JOINT}", "").replace(f"{JOINT}>", "") if JOINT in w else f"<{w}>" for w in words]
    chars = np.frombuffer("".join(edged).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, edged), np.int64, len(edged))
    end = np.cumsum(size)
    start, word = end - size, np.repeat(np.arange(len(edged)), size)
    left = np.repeat(end, size) - np.arange(len(chars))
    row, out = [], []
    for k in (2, 3):
        at = np.flatnonzero(left >= k)
        row.append(word[at])
        out.append(_hashed(k, [chars[at + i] for i in range(k)]))
    head, tail = chars[start] == ord("<"), chars[end - 1] == ord(">")
    letters_in = size - head - tail
    for k in range(1, 5):
        own = np.flatnonzero(head & (letters_in >= k))
        row.append(own)
        out.append(_hashed(10 + k, [chars[start[own] + 1 + i] for i in range(k)]))
        own = np.flatnonzero(tail & (letters_in >= k))
        row.append(own)
        out.append(_hashed(20 + k, [chars[end[own] - 1 - k + i] for i in range(k)]))
    known = [i for i, w in enumerate(words) if w in lexicon]
    row.append(np.array(known, np.int64))
    out.append(np.array([crc32(words[i].encode()) % SPACE for i in known], np.int64))
    return np.concatenate(row), np.concatenate(out)


@dataclass
class Field:
    """labels; weights: SPACE x labels; transition: labels x labels; the last two are log potentials."""

    labels: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray
    transition: np.ndarray

    def emission(self, words: list[str]) -> np.ndarray:
        """Log potentials (words x labels) of words of letters."""
        row, f = features(words, self.lexicon)
        return np.stack([np.bincount(row, self.weights[f, j], len(words)) for j in range(len(self.labels))], 1).astype(np.float32)


@dataclass
class Messages:
    """Scaled messages of words in the order `place` (numbers into the given words): local potentials, forward and backward
    messages, and `last`, which words end a block of the work (but maybe not a sequence)."""

    place: np.ndarray
    local: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray

    def posteriors(self) -> np.ndarray:
        out = self.alpha * self.beta
        return out / out.sum(1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def messages(emission: np.ndarray, ends: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> Messages:
    """Forward and backward messages of whole sequences, exactly. emission: words x labels; ends: their exclusive ends.

    Sequences are cut into blocks that are worked on side by side, the t-th words of all blocks in one step. What goes in
    at a block's edges comes from products of the blocks' own transfer matrices, so the cuts change nothing.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    parts = -(-(ends - starts) // block)
    seq = np.repeat(np.arange(len(ends)), parts)
    k = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = starts[seq] + k * block
    size = np.minimum(ends[seq], start + block) - start
    order = np.argsort(-size, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    start, size = start[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # blocks of more than t words
    at = np.cumsum(live) - live
    step = np.repeat(np.arange(longest), live)
    place = start[np.arange(len(step)) - at[step]] + step
    local = emission[place]
    local = np.exp(local - local.max(1, keepdims=True))
    move = np.exp(transition - transition.max()).astype(local.dtype)
    into = np.ones((len(order), local.shape[1]), local.dtype)
    back_into = into.copy()
    if longest and parts.max() > 1:
        # S of a block: its words' potentials with the moves between them, from any label at its start to any at its end.
        many = parts[seq][order] > 1
        s = np.zeros((len(order), *move.shape), local.dtype)
        for t in range(longest):
            n = live[t]
            now = local[at[t] : at[t] + n, None, :]
            own = (s[:n].reshape(-1, len(move)) @ move).reshape(n, *move.shape) * now if t else np.eye(len(move), dtype=local.dtype) * now
            s[:n] = own / own.sum((1, 2), keepdims=True)
        s[~many] = 0
        first = np.cumsum(parts) - parts
        for j in range(1, int(parts.max())):
            own = first[parts > j] + j
            before, here = rank[own - 1], rank[own]
            into[here] = _unit(np.einsum("bi,bij->bj", into[before], s[before]) @ move)
        for j in range(int(parts.max()) - 2, -1, -1):
            own = first[parts > j + 1] + j
            here, after = rank[own], rank[own + 1]
            back_into[here] = _unit(np.einsum("bij,bj->bi", s[after], back_into[after]) @ move.T)
    alpha, beta = np.empty_like(local), np.empty_like(local)
    now = into
    for t in range(longest):
        n, a = live[t], at[t]
        now = ((now[:n] @ move) if t else now) * local[a : a + n]
        now /= now.sum(1, keepdims=True)
        alpha[a : a + n] = now
    for t in range(longest - 1, -1, -1):
        n, a = live[t], at[t]
        back = back_into[:n].copy()
        if t + 1 < longest and (m := live[t + 1]):
            b = at[t + 1]
            back[:m] = _unit((local[b : b + m] * beta[b : b + m]) @ move.T)
        beta[a : a + n] = back
    return Messages(place, local, alpha, beta)


def forward_backward(emission: np.ndarray, ends: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior label probabilities of each word, in the order given."""
    found = messages(emission, ends, transition, block)
    out = np.empty_like(found.alpha)
    out[found.place] = found.posteriors()
    return out


def gradient(emission: np.ndarray, gold: np.ndarray, ends: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative conditional log likelihood of the gold labels: by the emissions and by the transitions.

    Both are expected minus observed counts; the expected pairs come from the messages on both sides of a transition.
    """
    found = messages(emission, ends, transition)
    alpha, after = np.empty_like(found.alpha), np.empty_like(found.alpha)
    alpha[found.place], after[found.place] = found.alpha, found.local * found.beta
    d = np.empty_like(found.alpha)
    d[found.place] = found.posteriors()
    d[np.arange(len(gold)), gold] -= 1
    inside = np.ones(len(gold), bool)
    inside[ends - 1] = False
    i = np.flatnonzero(inside)
    pair = alpha[i][:, :, None] * np.exp(transition - transition.max())[None] * after[i + 1][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    dt = pair.sum(0)
    np.add.at(dt, (gold[i], gold[i + 1]), -1)
    return d, dt


def fit_field(snippets: list[tuple[str, list[str]]], epochs: int = 8, group: int = 32, seed: int = 11) -> Field:
    """Fit on (language, words) snippets by AdaGrad on the conditional log likelihood.

    Training sequences join two to four snippets of any languages, so the transitions learn both staying and switching.
    The lexicon is each word that ten snippets or more have in common.
    """
    labels = sorted({lang for lang, _ in snippets})
    number = {lang: i for i, lang in enumerate(labels)}
    seen = Counter(w for _, words in snippets for w in set(words))
    lexicon = frozenset(w for w, n in seen.items() if n >= 10)
    code = {w: i for i, w in enumerate(seen)}
    word, feature = features(list(code), lexicon)
    order = np.argsort(word, kind="stable")
    # Only features that occur are fitted.
    used, own = np.unique(feature[order], return_inverse=True)
    size = np.bincount(word, minlength=len(code))
    start = np.cumsum(size) - size
    weights, transition = np.zeros((len(used), len(labels))), np.zeros((len(labels), len(labels)))
    g_w, g_t = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    coded = [(number[lang], np.array([code[w] for w in words])) for lang, words in snippets]
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(labels) > 1 else 0):
        mixed, joined, at = rng.permutation(len(coded)), [], 0
        while at < len(mixed):
            n = int(rng.integers(2, 5))
            joined.append(mixed[at : at + n])
            at += n
        for lo in range(0, len(joined), group):
            part = joined[lo : lo + group]
            words = np.concatenate([coded[k][1] for seq in part for k in seq])
            gold = np.concatenate([np.full(len(coded[k][1]), coded[k][0]) for seq in part for k in seq])
            ends = np.cumsum([sum(len(coded[k][1]) for k in seq) for seq in part])
            n = size[words]
            first = np.cumsum(n) - n
            f = own[np.arange(n.sum()) + np.repeat(start[words] - first, n)]
            d, dt = gradient(np.add.reduceat(weights[f], first), gold, ends, transition)
            spread = np.repeat(np.arange(len(words)), n)
            dw = np.stack([np.bincount(f, d[spread, j], len(used)) for j in range(len(labels))], 1) / len(gold) + 1e-6 * weights
            dt = dt / len(gold)
            g_w += dw * dw
            g_t += dt * dt
            weights -= 0.3 * dw / np.sqrt(g_w)
            transition -= 0.1 * dt / np.sqrt(g_t)
    whole = np.zeros((SPACE, len(labels)), np.float32)
    whole[used] = weights
    return Field(labels, lexicon, whole, transition.astype(np.float32))


def fit_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = 6000, snippet: int = 40, **options) -> Field | None:
    """Fit on at most `bound` rows with a language, a run of `snippet` words from a hashed place of each. None without rows."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = known.groupBy(id_col).agg(F.min(lang_col).alias("__lang"))
    sample = labelled_sample(docs.select(id_col, F.col(text_col).alias("text")), ids, id_col, bound)

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        out = []
        for text in texts.to_pylist():
            words = [w for x in split_words(text) if (w := letters(x))]
            at = crc32(text.encode()) % max(1, len(words) - snippet + 1)
            out.append(words[at : at + snippet])
        return pa.RecordBatch.from_arrays([part.column(1), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])

    rows = map_texts(sample.select("text", "__lang"), "text", "lang string, words array<string>", step).where(F.size("words") > 0).toArrow()
    snippets = sorted(zip(rows["lang"].to_pylist(), rows["words"].to_pylist(), strict=True))
    return fit_field(snippets, **options) if snippets else None


class _Labeller:
    """A task's word cache: word -> code, code -> emission; code 0 is a word without letters."""

    def __init__(self, field: Field):
        self.field = field
        self.reset()

    def reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.new: list[str] = []
        self.held = 1
        self.emission = np.zeros((1 << 14, len(self.field.labels)), np.float32)

    def code(self, word: str) -> int:
        if (known := self.codes.get(word)) is not None:
            return known
        if (w := letters(word)) == "":
            out = 0
        elif w != word:
            out = self.code(w)
        else:
            self.new.append(w)
            out = self.held + len(self.new) - 1
        self.codes[word] = out
        return out

    def flush(self) -> None:
        while self.held + len(self.new) > len(self.emission):
            self.emission = np.concatenate([self.emission, np.zeros_like(self.emission)])
        for lo in range(0, len(self.new), 4096):
            words = self.new[lo : lo + 4096]
            self.emission[self.held : self.held + len(words)] = self.field.emission(words)
            self.held += len(words)
        self.new = []

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x labels) mean posteriors over each text's words with letters, and how many such words there are."""
        if len(self.codes) > CACHE_WORDS:
            self.reset()
        codes, counts, look = [], [], self.codes.get
        for text in texts:
            words = split_words(text.lower())
            counts.append(len(words))
            found = [look(w) for w in words]
            if None in found:
                found = [self.code(w) if c is None else c for w, c in zip(words, found, strict=True)]
            codes.append(np.array(found, np.int32))
        self.flush()
        code, row = np.concatenate(codes), np.repeat(np.arange(len(texts)), counts)
        lettered = code > 0
        code, row = code[lettered], row[lettered]
        n = np.bincount(row, minlength=len(texts))
        some = n > 0
        found = messages(self.emission[code], np.cumsum(n[some]), self.field.transition)
        p, row = found.posteriors(), row[found.place]
        total = np.stack([np.bincount(row, p[:, j], len(texts)) for j in range(p.shape[1])], 1)
        return total / np.maximum(n, 1)[:, None], n


def label_words(text: str, field: Field) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word with letters, for looking at code-switched text."""
    words = [w for w in split_words(text) if letters(w)]
    if not words:
        return []
    made = _Labeller(field)
    code = [made.code(w) for w in words]
    made.flush()
    p = forward_backward(made.emission[code], np.array([len(words)]), field.transition)
    return [(w.strip(JOINT), field.labels[j], float(q[j])) for w, q, j in zip(words, p, p.argmax(1), strict=True)]


def with_language(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """The input's rows and columns, then lang_pred and score of every whole text.

    lang_pred is the label with the largest mean posterior over the text's words, score that mean (0 to 1). Null texts
    and texts without a letter are "und" with score 0, as is everything when nothing could be learned. Columns of the
    input with those names are replaced. Map-only; the broadcast field has a fixed size (SPACE weights a label).
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def task():
        labeller = _Labeller(shared.value) if shared.value is not None else None

        def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if labeller is not None:
                share, n = labeller.shares(texts.to_pylist())
                best = share.argmax(1)
                pred = [labeller.field.labels[j] if k else UNKNOWN for j, k in zip(best, n, strict=True)]
                score = np.where(n > 0, np.minimum(1.0, share[np.arange(len(best)), best]), 0.0)
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*part.schema.names, "p", "s"])

        return step

    frame = docs.select(names).toDF(*[f"c{i}" for i in range(len(names))])
    schema = ", ".join([*[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)], "p string, s double"])
    return map_texts(frame, f"c{names.index(text_col)}", schema, task=task, limit=SLICE).toDF(*names, "lang_pred", "score")


def language_report(docs: DataFrame, bound: int = 6000) -> DataFrame:
    """doc_id, held_out (false for a null id), lang_pred, score; learns from rows whose crc32(doc_id) modulo 4 isn't 2. A row for each
    row of docs; texts that are null or have no letters get "und", as all do where nothing can be learned."""
    field = fit_language_id(docs.where(remainder("doc_id", 4) != 2), bound=bound)
    return with_language(docs.select("doc_id", "text"), field).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
