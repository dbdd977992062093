"""A sentencepiece BPE vocabulary as numpy tables, and the prefix lattice over words of equal length.

BPE merges never cross the edge between two pieces of the result, so what stands left of an edge is the encoding
of that prefix, and two pieces can stand side by side exactly if merging their joined text gives the two back.
Each prefix therefore has one last piece: the one piece that ends there, fits behind the last piece of the prefix
before it, and the lattice finds it for every prefix from left to right.

What follows a prefix depends on its last characters and their last pieces only, as many as the longest piece has. A run
without a space, however long, is therefore cut into rows of equal length that advance together, each from a guess; rows whose
guess differs from what the row before them ends with go again from there until they run as before.
"""

from __future__ import annotations

import functools
import re

import numpy as np

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PROBE_BITS, _PAIR_BITS = 20, 20
#: Characters (words x length) that one numpy lattice holds at most.
LATTICE_CHARS = 120_000
#: Words longer than this are cut into rows of ``ROW`` characters.
LONG_WORD, ROW = 1024, 256
#: Rounds in which all rows of a block go again together; what is still unsettled goes row by row.
ROUNDS = 3
#: Last piece of a prefix that a row does not know.
_UNKNOWN = -2
_SEGMENTS = re.compile(r" *[^ \n]+| +|\n[^ \n]*")
_SEGMENTS_ANY = re.compile(r" *[^ ]+| +")


class Vocabulary:
    """Pieces by substring hash, byte pieces, and a direct-mapped memory of which pieces may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.names = names
        self.unk = sp.unk_id()
        self.ids = {names[i]: i for i in normal}
        self.scores = {names[i]: sp.get_score(i) for i in normal}
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][3:-1], 16)] = i
        self.has_bytes = bool((self.byte_ids != self.unk).any())
        if any(SPACE in names[i].lstrip(SPACE) for i in normal):
            raise ValueError("pieces that reach over a space need whole texts")
        self.newline_breaks = not any("\n" in names[i] for i in normal)
        self.longest = max((len(names[i]) for i in normal), default=1)
        self.lengths = np.ones(self.size + 2, np.uint8)  # of a last piece: 1 for a character outside the vocabulary (-1), 0 before the first piece
        self.lengths[normal] = [len(names[i]) for i in normal]
        self.lengths[self.size] = 0
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        keys = np.array([self._hash(names[i]) for i in normal], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ids = keys[order], np.array(normal, np.int32)[order]
        self.seen = np.zeros(1 << _PROBE_BITS, bool)
        self.seen[self._slot(self.keys, _PROBE_BITS)] = True
        self.codes = np.zeros((self.size, self.longest), np.uint32)
        for i in normal:
            self.codes[i, : len(names[i])] = np.frombuffer(names[i].encode("utf-32-le"), np.uint32)
        self.pair_keys = np.full(1 << _PAIR_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.pair_fits = np.zeros(1 << _PAIR_BITS, bool)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(_BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def merged(self, text: str) -> list[str]:
        """Replay the merges on a short text: best score first, then leftmost."""
        parts = list(text)
        score = self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``right`` may follow ``left`` (``left`` = vocabulary size: ``right`` begins a word)."""
        keys = left.astype(np.uint64) * np.uint64(self.size + 1) + right.astype(np.uint64)
        slot = self._slot(keys, _PAIR_BITS)
        out = self.pair_fits[slot]
        missing = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            ok = np.empty(len(new), bool)
            for k, key in enumerate(new.tolist()):
                a, b = divmod(key, self.size + 1)
                want = [self.names[b]] if a == self.size else [self.names[a], self.names[b]]
                ok[k] = self.merged("".join(want)) == want
            out[missing] = ok[back]
            at = self._slot(new, _PAIR_BITS)
            self.pair_keys[at], self.pair_fits[at] = new, ok
        return out

    def probe(self, hashes: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
        """Piece ids of all substrings of one length, -1 where there is none; hits are compared in full."""
        ids = np.full(hashes.shape, -1, np.int32)
        row, col = np.nonzero(self.seen[self._slot(hashes, _PROBE_BITS)])
        if len(row):
            h = hashes[row, col]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == h)
            row, col, found = row[hit], col[hit], self.key_ids[at[hit]]
            same = np.ones(len(row), bool)
            for k in range(length):
                same &= codes[row, col + k] == self.codes[found, k]
            if length < self.longest:
                same &= self.codes[found, length] == 0
            ids[row[same], col[same]] = found[same]
        return ids

    def endings(self, codes: np.ndarray) -> np.ndarray:
        """[word, end, length - 1]: the piece of that length that ends there, -1 where there is none."""
        m, n = codes.shape
        top = min(self.longest, n)
        h = np.zeros((m, n + 1), np.uint64)
        for i in range(n):
            h[:, i + 1] = h[:, i] * _BASE + codes[:, i] + np.uint64(1)
        ending = np.full((m, n + 1, top), -1, np.int32)
        for k in range(1, top + 1):
            ending[:, k:, k - 1] = self.probe(h[:, k:] - h[:, :-k] * self.powers[k], codes, k)
        return ending

    def advance(self, ending: np.ndarray, last: np.ndarray, begin: int, again: np.ndarray | None = None) -> None:
        """Fill ``last`` from prefix ``begin`` on; rows ``again`` only until they run as they did before.

        The score of a candidate is 0 if it is a piece that fits and minus infinity otherwise, a single character that is
        no piece stands for itself (id -1); the maximum over candidate lengths is the last piece, its length the back pointer.
        """
        rows = np.arange(len(last)) if again is None else again
        alike = np.zeros(len(rows), np.int32)
        for end in range(begin, last.shape[1]):
            width = min(ending.shape[2], end)
            piece = ending[:, end, :width] if again is None else ending[rows, end, :width]
            before = (last[:, end - width : end] if again is None else last[rows, end - width : end])[:, ::-1]
            ok = (piece >= 0) & (before > _UNKNOWN)
            row, col = np.nonzero(ok)
            left = before[row, col]
            left[left < 0] = self.size  # what follows a character outside the vocabulary begins anew
            ok[row, col] = self.fits(left, piece[row, col])
            at = np.arange(len(rows))
            length = ok.argmax(1)
            found = np.where(ok[at, length], piece[at, length], -1)
            if again is None:
                last[:, end] = found
                continue
            alike = np.where(found == last[rows, end], alike + 1, 0)
            last[rows, end] = found
            open_rows = alike < self.longest
            rows, alike = rows[open_rows], alike[open_rows]
            if not len(rows):
                return

    def chain(self, codes: np.ndarray) -> np.ndarray:
        """Last piece at every prefix of one long word, block by block."""
        lead, n = self.longest - 1, len(codes)
        row = max(ROW, self.longest)
        out = np.full(n + 1, self.size, np.int32)
        entry = np.full(lead + 1, _UNKNOWN, np.int32)
        entry[-1] = self.size
        block = max(1, LATTICE_CHARS // row) * row
        for begin in range(0, n, block):
            some = codes[max(0, begin - lead) : begin + block]
            size = min(block, n - begin)
            padded = np.zeros(lead + -(-size // row) * row, np.uint32)
            padded[lead + size - len(some) : lead + size] = some
            cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, lead + row)[::row])
            ending = self.endings(cut)
            last = np.full((len(cut), lead + row + 1), _UNKNOWN, np.int32)
            last[:, lead] = self.size  # the guess: a row begins anew
            last[0, : lead + 1] = entry
            self.advance(ending, last, lead + 1)
            self.settle(cut, ending, last, lead, row)
            out[begin + 1 : begin + size + 1] = last[:, lead + 1 :].reshape(-1)[:size]
            entry = last[-1, row:]
        return out

    def settle(self, cut: np.ndarray, ending: np.ndarray, last: np.ndarray, lead: int, row: int) -> None:
        """Let every row begin with what the row before it ends with."""
        for _ in range(ROUNDS):
            wrong = np.flatnonzero((last[1:, : lead + 1] != last[:-1, row:]).any(1)) + 1
            if not len(wrong):
                return
            last[wrong, : lead + 1] = last[wrong - 1, row:]
            self.advance(ending, last, lead + 1, wrong)
        known: dict[tuple[bytes, bytes], np.ndarray] = {}
        for r in range(int(wrong[0]), len(last)):
            if (last[r, : lead + 1] != last[r - 1, row:]).any():
                key = (last[r - 1, row:].tobytes(), cut[r].tobytes())
                if key not in known:
                    last[r, : lead + 1] = last[r - 1, row:]
                    self.advance(ending, last, lead + 1, np.array([r]))
                    known[key] = last[r].copy()
                last[r] = known[key]

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (rows of code points): last piece and its length at every prefix. All words advance together."""
        m, n = codes.shape
        if n > LONG_WORD:
            last = np.stack([self.chain(word) for word in codes])
        else:
            last = np.full((m, n + 1), self.size, np.int32)  # before the first piece: the vocabulary's size
            self.advance(self.endings(codes), last, 1)
        return last, self.lengths[last]

    def segments(self, text: str) -> list[str]:
        """Cut a text where no piece can reach over: each segment is a run of spaces with what follows it.

        The first space of a segment is left out (the library puts one before every text); a segment that begins
        with a line break has none.
        """
        text = text.replace(SPACE, " ")
        if not text:
            return []
        if not self.newline_breaks:
            return [s[1:] for s in _SEGMENTS_ANY.findall(" " + text)]
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return [s if s[0] == "\n" else s[1:] for s in _SEGMENTS.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def surface(self, segment: str) -> str:
        """The segment as the library's model sees it."""
        if self.newline_breaks and segment[:1] == "\n":
            return segment
        return SPACE + segment.replace(" ", SPACE)

    def groups(self, segments):
        """Distinct segments by length, in blocks of bounded size: (segments, code points)."""
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s) + (not (self.newline_breaks and s[:1] == "\n")), []).append(s)
        for n, words in sorted(by_length.items()):
            step = max(1, LATTICE_CHARS // n)
            for i in range(0, len(words), step):
                some = words[i : i + step]
                joined = "".join(map(self.surface, some)).encode("utf-32-le")
                yield some, np.frombuffer(joined, np.uint32).reshape(len(some), n)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once per worker process; the file is at the same path everywhere."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
