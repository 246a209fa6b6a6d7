"""SentencePiece BPE encoding and decoding, exact, by backtracking over Aho-Corasick matches.

The model file is read with the library's own protobuf description; the library itself is not called to encode.
Encoding of one text:

1. Normalise as the model says (only the identity normaliser is supported: the dummy prefix, spaces as U+2581).
2. Cut before every run of U+2581. No piece holds U+2581 other than at its start, save pieces made of U+2581 only,
   whose score is below all others; so each cut segment merges on its own, and within it only the U+2581 that the
   word leaves unmerged at its start can still join those before it.
3. A word (split again at characters outside the vocabulary, which become byte pieces) is encoded by
   backtracking: at each position take the longest piece that an Aho-Corasick pass found there, keep it if its end
   is not marked failed and BPE would not merge across its border with the previous piece (checked by undoing both
   pieces' merges in rank order; the answer for a pair of pieces is remembered), else try the next shorter piece,
   which is the longest piece that starts it; when none fits, mark the position failed and step back one piece.
   Pieces that their own text does not encode to are never matched.
4. Runs of loose U+2581 symbols merge as the library merges ties of equal score: leftmost pair first.

Decoding joins the pieces, turns U+2581 into spaces, byte pieces into their bytes, drops control pieces and the
dummy prefix's space.

Defined cases: a null text is empty: begin and end ids only; a null id passes as null; repeated rows each get a
row; very long texts are encoded whole (segments above ``CACHED_CHARS`` characters are not cached); extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from exposight.llm.batches import map_values

SPACE = "▁"
SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
CACHED_CHARS = 64
CACHED_SEGMENTS = 1 << 18
CACHED_PAIRS = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def heap_bpe(symbols: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The library's merge order over ``symbols``: highest score first, ties to the leftmost; also the last merge."""
    symbols = list(symbols)
    alive = [True] * len(symbols)
    nxt = list(range(1, len(symbols))) + [-1]
    prv = list(range(-1, len(symbols) - 1))
    agenda: list = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right >= 0:
            joined = symbols[left] + symbols[right]
            if joined in score:
                heapq.heappush(agenda, (-score[joined], left, right, joined))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    last = None
    while agenda:
        _, left, right, joined = heapq.heappop(agenda)
        if not (alive[left] and alive[right] and nxt[left] == right and symbols[left] + symbols[right] == joined):
            continue
        last = (symbols[left], symbols[right])
        symbols[left], alive[right] = joined, False
        nxt[left] = nxt[right]
        if nxt[right] >= 0:
            prv[nxt[right]] = left
        offer(prv[left], left)
        offer(left, nxt[left])
    return [s for s, a in zip(symbols, alive) if a], last


class Model:
    """Pieces, ranks and the split of each piece of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or proto.trainer_spec.treat_whitespace_as_suffix:
            raise NotImplementedError(f"normaliser {spec.name!r}: only the identity normaliser is supported")
        if any(p.type == USER for p in proto.pieces):
            raise NotImplementedError("user-defined pieces are not supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.unk = proto.trainer_spec.unk_id
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL and len(p.piece) > 1}
        blank = {p: s for p, s in score.items() if set(p) == {SPACE}}
        inner = [p for p in score if SPACE in p[1:] and p not in blank]
        if inner or (blank and score and max(blank.values()) >= min(s for p, s in score.items() if p not in blank)):
            raise NotImplementedError("pieces with inner spaces scored above others are not supported")
        self.blank_score = blank
        self.score = {p: s for p, s in score.items() if p not in blank}
        self.chars = {p for p in self.id_of if len(p) == 1}
        # Ranks: single characters first, then merged pieces by falling score.
        merged = sorted(self.score, key=lambda p: (-self.score[p], self.id_of[p]))
        self.rank_piece = sorted(self.chars, key=lambda p: self.id_of[p]) + merged
        rank = {p: r for r, p in enumerate(self.rank_piece)}
        self.split = [(r, r) for r in range(len(self.rank_piece))]
        self.pair: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for p in merged:
            found, last = heap_bpe(list(p), self.score)
            if found != [p] or last is None:
                continue  # the piece's own text does not become it: never matched
            left, right = rank[last[0]], rank[last[1]]
            self.split[rank[p]] = (left, right)
            self.pair[(left, right)] = rank[p]
            self.automaton.add_word(p, rank[p])
        self.automaton.make_automaton()
        self.char_rank = {p: rank[p] for p in self.chars}
        self.ids_of_rank = [self.id_of[p] for p in self.rank_piece]
        self.rank_of_text = self.char_rank | {
            p: rank[p] for p in merged if self.split[rank[p]][0] != rank[p]
        }
        self.size = [len(p) for p in self.rank_piece]
        self.shorter = [self._starting_piece(p) for p in self.rank_piece]
        self._segments = _Segments(self)
        self._sides: dict[int, bool] = {}
        self.space_id = self.id_of.get(SPACE, -1)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    def valid_pair(self, a: int, b: int) -> bool:
        """Would BPE leave ranks ``a`` and ``b`` side by side? Undo their merges, latest first, checking the border."""
        limit = 1 << 62
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit = a
                a = self.split[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.split[a][1]
                    if a == limit:
                        return True

    def _starting_piece(self, piece: str) -> int:
        """Rank of the longest shorter piece that starts ``piece``, -1 if none does."""
        known = (self.rank_of_text.get(piece[:size]) for size in range(len(piece) - 1, 0, -1))
        return next((r for r in known if r is not None), -1)

    def _side_by_side(self, key: int) -> bool:
        """``valid_pair`` of the ranks in ``key``, remembered."""
        if len(self._sides) >= CACHED_PAIRS:
            self._sides.clear()
        found = self._sides[key] = self.valid_pair(key >> 32, key & 0xFFFFFFFF)
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ranks of the BPE encoding of ``text``, all of whose characters are pieces."""
        whole = self.rank_of_text.get(text)
        if whole is not None:
            return [whole]  # the longest match, first and ending at the end: kept at once
        n = len(text)
        sizes, shorter, sides = self.size, self.shorter, self._sides
        longest = list(map(self.char_rank.__getitem__, text))
        if self.automaton:
            for end, r in self.automaton.iter(text):
                longest[end + 1 - sizes[r]] = r  # the matches of one start arrive by rising end: the last is the longest
        usable = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        pos, r = 0, longest[0]
        while True:
            if tokens:
                before = tokens[-1] << 32
                while r >= 0:
                    if usable[pos + sizes[r]]:
                        fits = sides.get(before | r)
                        if fits or (fits is None and self._side_by_side(before | r)):
                            break
                    r = shorter[r]
            else:
                while r >= 0 and not usable[pos + sizes[r]]:
                    r = shorter[r]
            if r >= 0:
                tokens.append(r)
                pos += sizes[r]
                if pos == n:
                    return tokens
                r = longest[pos]
            else:
                usable[pos] = 0
                last = tokens.pop()
                pos -= sizes[last]
                r = shorter[last]

    def _segment(self, segment: str) -> list[int]:
        """Ids of one segment: U+2581 symbols, then a word."""
        if self.space_id < 0:
            return self._word(segment)  # U+2581 is outside the vocabulary
        spaces = len(segment) - len(segment.lstrip(SPACE))
        if spaces == len(segment):
            return list(self.blanks(spaces))
        if spaces < 2:
            return self._word(segment)
        ids = self._word(segment[spaces - 1 :])
        if ids[0] == self.space_id:
            return [*self.blanks(spaces), *ids[1:]]
        return [*self.blanks(spaces - 1), *ids]

    def _word(self, word: str) -> list[int]:
        """Ids of one word and its U+2581, if any; characters outside the vocabulary become byte pieces."""
        if self.chars.issuperset(word):
            return [self.ids_of_rank[r] for r in self.backtrack(word)]
        out: list[int] = []
        run_start = 0
        for i, c in enumerate(word + "\0"):
            known = i < len(word) and c in self.chars
            if not known:
                if run_start < i:
                    out.extend(self.ids_of_rank[r] for r in self.backtrack(word[run_start:i]))
                if i < len(word):
                    out.extend(self._unknown(c))
                run_start = i + 1
        return out

    def _unknown(self, c: str) -> list[int]:
        if self.byte_fallback:
            return [self.byte_id[b] for b in c.encode()]
        return [self.unk]

    @functools.lru_cache(maxsize=1024)
    def blanks(self, k: int) -> tuple[int, ...]:
        """Ids of ``k`` loose U+2581 symbols side by side."""
        found, _ = heap_bpe([SPACE] * k, self.blank_score)
        return tuple(self.id_of[p] for p in found)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str | None, bos: bool = True, eos: bool = True) -> list[int]:
        out = [self.bos] if bos else []
        out.extend(chain.from_iterable(map(self._segments.__getitem__, SEGMENTS.findall(self.normalise(text or "")))))
        if eos:
            out.append(self.eos)
        return out

    def _surface(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return (" ⁇ " if kind == UNKNOWN else self.pieces[i]).replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        joined = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix:
            # The dummy prefix's space: the leading U+2581 of the first piece that is not a control piece.
            first = next((i for i in ids if self.types[i] != CONTROL), None)
            if first is not None and self.types[first] in (NORMAL, UNUSED) and self.pieces[first].startswith(SPACE):
                joined = joined[1:]
        return joined.decode("utf-8", errors="replace")


class _Segments(dict[str, tuple[int, ...]]):
    """Segment → ids, worked out at first use; long segments are not kept.

    A full cache becomes the older one and a new one starts, so segments in use stay known.
    """

    def __init__(self, owner: Model):
        super().__init__()
        self.owner = owner
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = self.older.get(segment)
        if ids is None:
            ids = tuple(self.owner._segment(segment))
        if len(segment) <= CACHED_CHARS:
            if len(self) >= CACHED_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode with begin and end ids, decode, in one worker."""

    def work(texts: list) -> list[tuple]:
        m = model(path)
        found = []
        for t in texts:
            ids = m.encode(t)
            found.append((len(ids), ids_digest(ids), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
        return found

    return map_values(docs, id_col, text_col, work, "n_tokens long, ids_sha256 string, decoded_sha256 string")
