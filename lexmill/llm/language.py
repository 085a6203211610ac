"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled texts (whole ones of ``max_docs`` rows at
most, which together have ``max_bytes`` at most) recognises its substrings. A document is parsed greedily against each automaton: a phrase is the longest match from where
the last one ended, a symbol the automaton doesn't know is a phrase of its own. Phrases times log2 of the
learned length over the document's symbols estimates the cross entropy; the least wins, ties go to the
language with more learned rows, then to the smaller name.

Symbols are the bytes of the lower-cased text in UTF-8, with every run of ASCII non-letters as one space.
Documents are parsed in blocks of ``BLOCK`` symbols, thousands of which advance together, one gather a symbol,
all languages at once, each first from a fresh phrase. Then the phrase that a document's block before left open
is carried into each block beside the fresh parse, until both are in one state; from there on they are the same.
Counts are thus those of one parse from the first symbol to the last.

Defined cases: null texts and texts without a letter are ``und`` with score 0 (numerals like a half or a circled
one are no letters); without learned text every document is ``und``; equal texts get equal results; columns
beyond the id, the text and those kept take no part, and kept ones may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, id_crc_mod, small_batches

BLOCK = 1024
SPACE, END = 0, 1  # codes of a space and of padding; the rest are the bytes seen
WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numerals that are no digits
KEEP = np.full(256, 32, np.uint8)
KEEP[97:123] = np.arange(97, 123)
KEEP[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def symbols(text: str) -> np.ndarray:
    """The bytes that are parsed."""
    b = KEEP[np.frombuffer(text.lower().encode(), np.uint8)]
    if not len(b):
        return b
    space = b == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = True
    return b[keep]


class Automaton:
    """Suffix automaton of a byte string: from each state, the states that one more byte leads to."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Parser:
    """Automata of several languages as one sparse table.

    An edge of state s with symbol c is at base[s] + c, where ``check`` names s; rows of different states are pushed
    into each other's gaps, so a state takes about its edges' room, whatever the alphabet. Where a state has no such edge
    the phrase ends and the language's ``fresh`` row says where the next one begins, and whether the symbol is unknown."""

    def __init__(self, samples: dict[str, bytes], weight: dict[str, int]):
        # ties go to the first
        self.langs = sorted(samples, key=lambda k: (-weight.get(k, 0), k))
        seen = sorted({b for s in samples.values() for b in s} - {32})
        self.code = np.full(256, len(seen) + 2, np.int32)  # unseen bytes share the last code
        self.code[32] = SPACE
        for i, b in enumerate(seen):
            self.code[b] = i + 2
        self.width = len(seen) + 3
        self.bits = np.array([np.log2(max(2, len(samples[k]))) for k in self.langs])
        codes = self.code.tolist()
        roots, states, slots = [], 0, 0
        fresh = np.zeros((len(self.langs), self.width), np.int32)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, k in enumerate(self.langs):
            nxt = Automaton(samples[k]).next
            roots.append(states)
            fresh[n] = states * 2 + 1
            fresh[n, END] = states * 2  # padding is no symbol
            for c, to in nxt[0].items():
                fresh[n, codes[c]] = (states + to) * 2
            base, check, to = self._pushed([{codes[c]: to for c, to in e.items()} for e in [{}, *nxt[1:]]])
            parts.append((base + slots, np.where(check < 0, -1, check + states).astype(np.int32), to + states))
            states, slots = states + len(nxt), slots + len(check)
        empty = np.zeros(0, np.int32)
        self.base, self.check, self.next = (np.concatenate([p[i] for p in parts]).astype(np.int32) if parts else empty for i in range(3))
        self.roots, self.fresh = np.array(roots, np.int32), fresh.ravel()

    def _pushed(self, edges: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base by state, and check and next by slot, of one automaton: states of many edges first, each into the first gaps that hold its edges."""
        total, width = sum(map(len, edges)), self.width
        base, used, top, at = np.zeros(len(edges), np.int64), bytearray(2 * total + 2 * width), 0, 0
        order = sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: -len(edges[s]))
        last = 0
        for s in order:
            own = list(edges[s])
            if len(own) != last:
                last, at = len(own), 0
            tries = 0
            while any(used[at + c] for c in own):
                at, tries = at + 1, tries + 1
                if tries == 64:  # few gaps are left hereabouts
                    at = max(at, top - width)
                if at + width > len(used):
                    used.extend(bytes(len(used)))
            base[s] = at
            for c in own:
                used[at + c] = 1
            top = max(top, at + max(own) + 1)
        free = np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0) + width  # a base is no negative number
        single = [s for s, e in enumerate(edges) if len(e) == 1]
        if len(single) > len(free):
            free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
        for s, slot in zip(single, free.tolist()):
            base[s] = slot - next(iter(edges[s]))
        size = max(top, int(free[: len(single)].max(initial=-1)) + 1, int(base.max(initial=0))) + width
        check, to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for s, e in enumerate(edges):
            for c, t in e.items():
                check[base[s] + c], to[base[s] + c] = s, t
        return base, check, to

    def _step(self, state: np.ndarray, symbol: np.ndarray, root: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and how many phrases end on the way; row is where the language's fresh row begins."""
        at = self.base.take(state) + symbol
        on, fresh = self.check.take(at) == state, self.fresh.take(row + symbol)
        return np.where(on, self.next.take(at), fresh >> 1), np.where(on, 0, (state != root) + (fresh & 1))

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each document in each language."""
        sizes = np.array([len(d) for d in docs])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(docs)), blocks)
        out = np.zeros((len(docs), len(self.langs)), np.int64)
        if not len(owner):
            return out
        flat = np.full(len(owner) * BLOCK, END, np.uint8)
        at = np.concatenate([[0], np.cumsum(blocks)])[:-1] * BLOCK
        for d, a in zip(docs, at.tolist()):
            flat[a : a + len(d)] = self.code[d]
        # longest blocks first, so that ended ones fall off the end
        left = np.minimum(BLOCK, sizes[owner] - (np.arange(len(owner)) - (at // BLOCK)[owner]) * BLOCK)
        order = np.argsort(-left, kind="stable")
        grid = np.ascontiguousarray(flat.reshape(-1, BLOCK)[order].T)
        alive = np.searchsorted(-left[order], -np.arange(BLOCK), "left")
        root, row = self.roots[:, None], (np.arange(len(self.langs), dtype=np.int32) * self.width)[:, None]
        state = np.repeat(root, len(owner), 1)
        count = np.zeros(state.shape, np.int32)
        for t in range(BLOCK):
            n = int(alive[t])
            if not n:
                break
            state[:, :n], ended = self._step(state[:, :n], grid[t, :n], root, row)
            count[:, :n] += ended
        if len(owner) > len(docs):
            place = np.empty(len(owner), np.int64)
            place[order] = np.arange(len(owner))
            same = owner[1:] == owner[:-1]
            after = np.full(len(owner), -1)
            after[place[:-1][same]] = place[1:][same]
            count = count + self._carried(state, after, grid, left[order])
            last = after < 0
        else:
            last = np.ones(len(owner), bool)
        count = count + np.where(last, state != root, 0)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner[order], count[k], len(docs))
        return out

    def _carried(self, state: np.ndarray, after: np.ndarray, grid: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What carrying open phrases from block to block adds to the blocks' phrases.

        state holds the blocks' last states by language and becomes the true ones; after is the block that follows, or -1."""
        fresh, add = state.copy(), np.zeros(state.shape, np.int32)
        lang, block = np.nonzero(np.broadcast_to(after >= 0, state.shape))
        enter, block = state[lang, block], after[block]
        while len(lang):
            own, new, root, row = enter.copy(), self.roots[lang], self.roots[lang], lang * self.width
            more, end = np.zeros(len(lang), np.int32), fresh[lang, block]
            on = np.flatnonzero(own != new)
            for t in range(BLOCK):
                ended = size[block[on]] <= t
                end[on[ended]] = own[on[ended]]
                on = on[~ended]
                if not len(on):
                    break
                symbol = grid[t, block[on]]
                own[on], v = self._step(own[on], symbol, root[on], row[on])
                new[on], w = self._step(new[on], symbol, root[on], row[on])
                more[on] += v - w
                on = on[own[on] != new[on]]
            end[on] = own[on]
            add[lang, block] = more
            # a block that ends in another state than was thought changes the one after it
            moved = (end != state[lang, block]) & (after[block] >= 0)
            state[lang, block] = end
            lang, enter, block = lang[moved], end[moved], after[block[moved]]
        return add


_PARSERS: dict[int, Parser] = {}


def parser_of(samples: dict[str, bytes], weight: dict[str, int]) -> Parser:
    key = hash((tuple(sorted(samples.items())), tuple(sorted(weight.items()))))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(samples, weight)
    return _PARSERS[key]


def learn(documents: DataFrame, max_bytes: int = 65536, max_docs: int = 200, longest: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[dict[str, bytes], dict[str, int]]:
    """For each language the symbols of a sample of its labelled texts, and its number of labelled rows.

    The sample has whole texts: of the rows with the smallest hashes of their ids, those of an eighth of max_bytes or
    less first, as many as max_docs and max_bytes allow, and one at least, of which the first ``longest`` characters are
    read if it has more. Other labelled rows aren't learned from."""
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    weight = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    sized = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.octet_length(text_col).alias("size"))
    first = Window.partitionBy("lang").orderBy(F.col("size") > max_bytes // 8, F.xxhash64("id"), "id", "size")
    ids = sized.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_docs)
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy("n"))
    # max_docs ids per language at most; one that many rows have gives its smallest text of that size
    ids = ids.withColumn("upto", upto).where((F.col("upto") <= max_bytes) | (F.col("n") == 1)).groupBy("id", "lang", "size").agg(F.min("n").alias("n"))
    texts = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.octet_length(text_col).alias("size"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids), ["id", "lang", "size"]).groupBy("lang", "n").agg(F.left(F.min("text"), F.lit(longest)).alias("text"))
    samples: dict[str, bytes] = {}
    for r in texts.orderBy("lang", "n").toLocalIterator():
        samples[r.lang] = samples.get(r.lang, b"") + b" " + symbols(r.text).tobytes()
    return samples, weight


def predict(documents: DataFrame, model: tuple[dict[str, bytes], dict[str, int]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), out: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """Rows (id, *keep, lang_pred, score, bits), or by the names in out: score is the runner-up's share of the two entropies' sum, bits the winner's entropy per symbol."""

    cols = [id_col, *[c for c in keep if c != id_col]]
    text_name = free_name("text", cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(*model)
        for b in small_batches(batches, text_name, 2 << 20):
            texts = b.column(b.schema.get_field_index(text_name)).to_pylist()
            known = [bool(x) and bool(parser.langs) and has_letter(x) for x in texts]
            docs = [symbols(x) if k else np.zeros(0, np.uint8) for x, k in zip(texts, known)]
            ent = parser.phrases(docs) * parser.bits / np.maximum(1, [len(d) for d in docs])[:, None] if parser.langs else np.zeros((len(docs), 1))
            best = ent.argmin(1)
            low = ent.min(1)
            rest = np.sort(ent, 1)[:, 1] if ent.shape[1] > 1 else low + 1
            share = np.where(low + rest > 0, rest / np.maximum(1e-300, low + rest), 0.0)
            name = [parser.langs[i] if k else "und" for i, k in zip(best, known)]
            own = [c for c in range(b.num_columns) if b.schema.names[c] != text_name]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in own] + [pa.array(name, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, low, 0.0))],
                names=[b.schema.names[c] for c in own] + list(out),
            )

    kinds = dict(documents.dtypes)
    src = documents.select(*[F.col(f"`{c}`") for c in cols], F.col(text_col).alias(text_name))
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", `{}` string, `{}` double, `{}` double".format(*out))


def entropy_bounds(documents: DataFrame, model: tuple[dict[str, bytes], dict[str, int]], share: float = 0.999, times: float = 2.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each learned language ``times`` the entropy per symbol that a ``share`` of all its labelled rows stay within."""
    labelled = documents.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = predict(labelled, model, "id", "text", ["lang"]).where("lang = lang_pred")
    return {r[0]: times * r[1] for r in found.groupBy("lang").agg(F.percentile_approx("bits", share, 10000)).collect()}  # one row per language


def within(bounds: dict[str, float], lang: str = "lang_pred", bits: str = "bits") -> Column:
    """Whether a prediction is a language, and the text fits it."""
    most = F.lit(float("inf"))
    for name, bound in bounds.items():
        most = F.when(F.col(lang) == name, bound).otherwise(most)
    return (F.col(lang) != "und") & (F.col(bits) <= most)


def languages(documents: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; nothing of the held-out fold (crc32 of the id modulo folds) is learned."""
    model = learn(documents.where(id_crc_mod("doc_id", folds) != held_out))
    out = predict(documents, model)
    return out.select("doc_id", (id_crc_mod("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
