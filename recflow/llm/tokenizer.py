"""Encoding with the public byte-level BPE vocabulary, for texts of any length.

A text of more than ``SEGMENT_CHARS`` characters is cut into segments, the segments are encoded apart,
and neighbours are joined in a tree by encoding a window around the join again; the window grows until
both sides agree exactly.  A cut inside one unsplit piece joins the tokens of its two parts; a cut before
white space needs no window.

Why the joins are exact.  The splitting pattern looks at most one character ahead and never
behind, so scanning from any true piece boundary gives the true pieces from there on.  All
pieces of a segment but those that touch its end are therefore true pieces if the segment
starts at a true boundary, and once the scan of a window meets a boundary of the right
segment, both agree from there on.  Inside one long piece, a sequence of tokens is the
encoding of its bytes if and only if each pair of neighbours is what the pair's bytes are
encoded to; so a join holds as soon as the pairs on the window's borders are compatible.
"""

from __future__ import annotations

import base64
from functools import lru_cache

#: Characters of a segment: a leaf of the tree.
SEGMENT_CHARS = 2_048
#: Bytes of one unsplit piece that are encoded in one go.
LEAF_BYTES = 256


def vocabulary_dir() -> str:
    import public_tokenizers

    import os

    return os.path.dirname(public_tokenizers.__file__)


class PieceEncoder:
    """Exact encoding of pieces of any length, by joining the encodings of halves."""

    def __init__(self, ranks_path: str, leaf: int = LEAF_BYTES):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.leaf = leaf
        self._fits: dict[tuple[int, int], bool] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def compatible(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            known = self._fits[a, b] = self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings of parts of one piece."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            cut, end = max(0, len(left) - k), min(k, len(right))
            middle = self._leaf_or_halves(self._bytes(left[cut:] + right[:end]))
            if (cut == 0 or self.compatible(left[cut - 1], middle[0])) and (end == len(right) or self.compatible(middle[-1], right[end])):
                return left[:cut] + middle + right[end:]
            k *= 2

    def _leaf_or_halves(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf * 4:
            return self.encoding._encode_single_piece(piece)
        return self.piece(piece)

    def piece(self, piece: bytes) -> list[int]:
        parts = [self.encoding._encode_single_piece(piece[i : i + self.leaf]) for i in range(0, len(piece), self.leaf)]
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def pieces(self, text: str, start: int = 0, end: int | None = None):
        """(start, end) of each piece of a scan of text[start:end]."""
        part = text[start:end]
        for m in self.pattern.finditer(part):
            yield start + m.start(), start + m.end()

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self._encode_piece(text, *p)]

    def join_segments(self, text: str, cuts: list[int], parts: list[list[int]]) -> list[int]:
        """Encoding of ``text`` out of the encodings of text[cuts[i]:cuts[i+1]].

        A tree of joins: each join replaces what lies between the last sure boundary of the left
        side and the first boundary on which both sides agree.
        """
        spans = list(zip(cuts[:-1], cuts[1:], parts, strict=True))
        while len(spans) > 1:
            joined = []
            for i in range(0, len(spans), 2):
                if i + 1 == len(spans):
                    joined.append(spans[i])
                    continue
                (a, m, left), (_, b, right) = spans[i], spans[i + 1]
                joined.append((a, b, self._join_at(text, a, m, b, left, right)))
            spans = joined
        return spans[0][2] if spans else []

    def encode_long(self, text: str, size: int = SEGMENT_CHARS) -> list[int]:
        """Encoding of a text of any length by the tree."""
        if len(text) <= size:
            return self.encoding.encode_ordinary(text)
        cuts = cut_points(text, size)
        return self.join_segments(text, cuts, [self.encoding.encode_ordinary(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    @staticmethod
    def _sure(text: str, a: int, at: int) -> int:
        """The last sure boundary up to ``at``: the start of white space after something else, else ``a``."""
        while at > a:
            p = max(text.rfind(c, a + 1, at + 1) for c in " \n\u3000\t")
            while p > a and text[p - 1].isspace():
                p -= 1
            if p > a:
                return p
            return a
        return a

    def _tokens_of(self, ids: list[int], n_bytes: int) -> int:
        """How many of the first ``ids`` hold so many bytes; -1 if none do."""
        seen = k = 0
        while seen < n_bytes and k < len(ids):
            seen += len(self.bytes_of[ids[k]])
            k += 1
        return k if seen == n_bytes else -1

    def _join_piece(self, text: str, s: int, m: int, e: int, left: list[int], right: list[int]) -> list[int] | None:
        """The join of the two parts of one unsplit piece text[s:e]."""
        before, after = (len(text[x:y].encode("utf-8", "surrogatepass")) for x, y in ((s, m), (m, e)))
        i, j = self._tokens_of(left[::-1] if len(left) < 4096 else left[: -before - 1 : -1], before), self._tokens_of(right, after)
        if i < 0 or j < 0:
            return None
        return left[: len(left) - i] + self.join(left[len(left) - i :], right[:j]) + right[j:]

    def _join_at(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        if a < m < b and not text[m - 1].isspace() and text[m].isspace():
            return left + right  # white space after something else always starts a piece
        window = 256
        while True:
            lo, hi = self._sure(text, a, m - window), min(b, m + window)
            own_left = list(self.pieces(text, lo, m))
            if not text[m - 1].isspace() and not text[m].isspace():
                s = own_left[-1][0]
                whole, rest = self.pattern.match(text, s, b), self.pattern.match(text, m, b)
                if whole and rest and whole.end() == rest.end():
                    joined = self._join_piece(text, s, m, rest.end(), left, right)
                    if joined is not None:
                        return joined
            seen = list(self.pieces(text, lo, hi))
            own = list(self.pieces(text, m, hi))
            starts = {s for s, _ in own}
            agreed = next((s for s, _ in (seen if hi == b else seen[:-2]) if s > m and s in starts), b if hi == b else None)
            if agreed is not None:
                dropped = sum(len(self._encode_piece(text, *p)) for p in own_left)
                skipped = sum(len(self._encode_piece(text, *p)) for p in own if p[1] <= agreed)
                middle = [i for p in seen if p[1] <= agreed for i in self._encode_piece(text, *p)]
                return left[: len(left) - dropped] + middle + right[skipped:]
            window *= 2

    def _encode_piece(self, text: str, a: int, b: int) -> list[int]:
        raw = text[a:b].encode("utf-8", "surrogatepass")
        return self.piece(raw) if len(raw) > self.leaf * 4 else self.encoding._encode_single_piece(raw)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def cut_points(text: str, size: int) -> list[int]:
    """Segment borders: the last white space before each multiple of ``size`` if there is one in
    the last eighth of the segment, else that multiple itself."""
    cuts = [0]
    while len(text) - cuts[-1] > size:
        at = cuts[-1] + size
        back = next((p for p in range(at, at - size // 8, -1) if text[p].isspace() and not text[p - 1].isspace()), at)
        cuts.append(back)
    cuts.append(len(text))
    return cuts
