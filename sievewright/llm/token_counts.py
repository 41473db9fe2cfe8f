"""Token counts without tokens: a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece in a word; dynamic programming over the
word's character boundaries keeps the best score and the number of pieces on that path, never the
pieces. Rules of ties and unknown characters are the library's (tokenizers.models.Unigram): a path
is replaced only by a strictly better one, and starts are tried from the left, so of equal paths the
one with the longest last piece stays; a character that no one-character piece covers may be passed
at the least score less 10; unknown pieces in a row (written out or not) are one.

Words are cut at white space and get the mark U+2581 in front. The same word always has the same
count, so each task looks words up in a bounded table and searches only new ones, many at a time.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, encode

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A mark that the text has itself starts a new part.
MARKED = re.compile(f"{MARK}[^{MARK}]*")
#: White space for Python's split() only, not for the library.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPLIT_PLAIN = re.compile("[^\\t-\\r \\x85\\xa0 -     　]+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order; id 0 is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], keep: int = 600_000):
        import ahocorasick

        self.auto, self.table, self.too_long = ahocorasick.Automaton(), encode.Known(keep), []
        for i, (piece, _) in enumerate(pieces):
            if piece:
                self.auto.add_word(piece, i)
        self.auto.make_automaton()
        self.length = np.array([len(p) for p, _ in pieces], np.int64)
        self.score = np.array([s for _, s in pieces], np.float64)
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY

    def words(self, words: list[str]) -> list[int]:
        """Pieces of each word (without its mark), by one pass over all boundaries of equal rank."""
        if not words:
            return []
        marked = [MARK + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        at = np.concatenate(([0], np.cumsum(size + 1)[:-1]))  # a boundary more than characters
        text = "\n".join(marked)  # no word has a newline, so no piece spans two
        found = np.fromiter(chain.from_iterable(self.auto.iter(text)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        start = end - self.length[piece]
        alone = np.ones(len(text) + 1, bool)
        alone[start[self.length[piece] == 1]] = False
        alone[at + size] = False
        lone = np.flatnonzero(alone[: at[-1] + size[-1]])
        start, end = np.concatenate((start, lone)), np.concatenate((end, lone + 1))
        score = np.concatenate((self.score[piece], np.full(len(lone), self.unknown)))
        unknown = np.concatenate((piece == 0, np.ones(len(lone), bool)))
        rank = end - np.repeat(at, size + 1)[end]
        order = np.lexsort((start, end, rank))
        start, end, score, unknown, rank = start[order], end[order], score[order], unknown[order], rank[order]
        best = np.zeros(len(text) + 2)
        count = np.zeros(len(text) + 2, np.int64)
        last = np.zeros(len(text) + 2, bool)
        edges = np.searchsorted(rank, np.arange(1, rank[-1] + 2))
        for a, b in zip(edges[:-1], edges[1:]):
            s, e = start[a:b], end[a:b]
            path = score[a:b] + best[s]
            first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            top = np.maximum.reduceat(path, first)
            where = np.where(path == np.repeat(top, np.diff(np.r_[first, b - a])), np.arange(b - a), b - a)
            pick = np.minimum.reduceat(where, first)
            to, come, odd = e[first], s[pick], unknown[a:b][pick]
            best[to] = top
            count[to] = count[come] + 1 - (odd & last[come])
            last[to] = odd
        return count[at + size].tolist()

    def long_word(self, word: str) -> int:
        """One very long word, character by character: memory follows its length."""
        text = MARK + word
        best, count, last = [0.0] * (len(text) + 1), [0] * (len(text) + 1), [False] * (len(text) + 1)
        for end, group in self._by_end(text):
            top, pick = None, (0, False)
            for start, value, odd in group:
                path = value + best[start]
                if top is None or path > top:
                    top, pick = path, (start, odd)
            best[end], last[end] = top, pick[1]
            count[end] = count[pick[0]] + 1 - (pick[1] and last[pick[0]])
        return count[-1]

    def _by_end(self, text: str):
        """For each boundary the ways to reach it, longest first; the way over an unknown one last."""
        ways: list[tuple[int, float, bool]] = []
        now, alone = 1, True

        def closed():
            return sorted(ways) + [(now - 1, self.unknown, True)] * alone

        for last, piece in self.auto.iter(text):
            while last + 1 > now:
                yield now, closed()
                ways, now, alone = [], now + 1, True
            n = int(self.length[piece])
            ways.append((now - n, float(self.score[piece]), piece == 0))
            alone &= n != 1
        while now <= len(text):
            yield now, closed()
            ways, now, alone = [], now + 1, True

    def texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        cut = [(SPLIT_PLAIN.findall(t) if ODD_SPACE.search(t) else t.split()) for t in texts]
        n_words = [len(ws) for ws in cut]
        cut = [[part[1:] for w in ws for part in MARKED.findall(w if w[0] == MARK else MARK + w)] if MARK in t else ws for t, ws in zip(texts, cut)]
        get = self.table.lookup(set(chain.from_iterable(cut)), self.search)
        out = [(n, sum(map(get, ws))) for n, ws in zip(n_words, cut)]
        for w in self.too_long:
            self.table.pop(w, None)
        return out

    def search(self, words: list[str]) -> list[int]:
        """Pieces of each word, the very long ones one by one."""
        short = [w for w in words if len(w) <= 120]
        self.too_long = [w for w in words if len(w) > 120]
        found: dict[str, int] = {}
        for i in range(0, len(short), 10_000):
            found.update(zip(short[i : i + 10_000], self.words(short[i : i + 10_000])))
        found.update((w, self.long_word(w)) for w in self.too_long)
        return [found[w] for w in words]


def model_counter(model: str) -> Counter:
    return Counter(vocabulary(model))


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text; model is a sentencepiece file whose pieces and
    scores are taken as a unigram vocabulary.

    Null and empty texts have 0 of both. Nothing is shuffled and no token leaves a task.
    """

    def run(batches):
        counter = encode.worker_wide(model_counter, model)
        for batch in batches:
            texts, out = [x or "" for x in batch.column(1).to_pylist()], []
            for a, b in encode.slices(texts):
                out += counter.texts(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = common.keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long").select(common.id_out(), "n_words", "n_tokens")
