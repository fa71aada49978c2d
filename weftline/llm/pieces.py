"""Exact encoding and decoding with merge-type SentencePiece vocabularies.

A text is encoded left to right: the longest piece at each place (one Aho-Corasick pass gives
them all) is tried first, a piece may follow another only if merging their joint text again
leaves the border between them standing, and a place from which no piece leads on is marked in a
bitfield and never tried again. What comes out is the result of the merges, without doing them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
_NEVER = 1 << 60
#: Entries that a worker keeps of compared pairs, and twice of encoded segments.
_KEEP = 300_000


@dataclass
class Vocabulary:
    """Pieces of a merge-type model: rank of each (lower merges first), ids, and how text is prepared."""

    ids: dict[str, int]
    ranks: dict[str, int]
    bytes_: list[int]
    unknown: int
    end: int
    texts: list[bytes]
    control: frozenset[int]
    byte_of: dict[int, int]
    prefix: bool = True
    _made: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model on the driver. Models that normalise text, or lack byte pieces, are refused."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = [(model.is_control(i), model.is_byte(i), model.is_unknown(i)) for i in range(n)]
        plain = [i for i in range(n) if not any(kinds[i]) and not model.is_unused(i)]
        names = [model.id_to_piece(i) for i in range(n)]
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        byte_of = {i: int(names[i][3:5], 16) for i in range(n) if kinds[i][1]}
        if len(byte_of) != 256:
            raise ValueError("the model has no byte pieces")
        if model.normalize(" a  Åﬁ ") != SPACE * 2 + "a" + SPACE * 2 + "Åﬁ" + SPACE:
            raise ValueError("the model normalises text")
        ranks = {names[i]: k for k, i in enumerate(by_score) if len(names[i]) > 1}
        if any(c not in names for p in ranks for c in p if model.piece_to_id(c) == model.unk_id()):
            raise ValueError("a piece holds a character that is no piece")
        return Vocabulary(
            ids={names[i]: i for i in plain},
            ranks=ranks,
            bytes_=[i for i, _ in sorted(byte_of.items(), key=lambda x: x[1])],
            unknown=model.unk_id(),
            end=model.eos_id(),
            texts=[_spoken(names[i], *kinds[i]) for i in range(n)],
            control=frozenset(i for i in range(n) if kinds[i][0]),
            byte_of=byte_of,
        )


def _spoken(name: str, control: bool, byte: bool, unknown: bool) -> bytes:
    """What a piece says when decoded."""
    if byte:
        return bytes([int(name[3:5], 16)])
    return b"" if control else " \u2047 ".encode() if unknown else name.replace(SPACE, " ").encode()


def merged(text: str, ranks: dict[str, int]) -> list[str]:
    """The merges done one by one: best rank first, leftmost among equals. For single pieces and tests."""
    parts = list(text)
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if rank == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _segments(ranks: dict[str, int]) -> str:
    """A pattern for stretches of text that merges stay within.

    Merges never cross two characters that no piece holds side by side. Vocabularies mostly
    have no piece in which a space follows anything else, nor one in which anything but a
    letter follows a letter; the letters for which one does are exceptions.
    """
    letter = re.compile(r"[^\W\d_]").match
    beside = {x for p in ranks for x in zip(p, p[1:], strict=False)}
    if any(b == SPACE != a for a, b in beside):
        return "(?s).+"
    other = f"(?:[^\\w{SPACE}]|[\\d_])"
    odd = "".join(sorted(re.escape(a) for a in {a for a, b in beside if letter(a) and not letter(b)}))
    goes_on = f"|(?<=[{odd}]){other}+" if odd else ""
    plain = f"{SPACE}[^\\W\\d_{odd}]++" + (f"(?![{odd}])" if odd else "")  # most stretches
    return f"{plain}|{SPACE}*{other}*(?:[^\\W\\d_]{goes_on})+|{SPACE}*{other}+|{SPACE}+"


class Encoder:
    """Encodes texts with one vocabulary; made once in each worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.ranks = vocabulary, vocabulary.ranks
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.ids:
            self.automaton.add_word(piece, len(piece) - 1)
        self.automaton.make_automaton()
        self.sides: dict[str, tuple] = {}
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.segments = re.compile(_segments(self.ranks)).findall

    def _sides(self, piece: str) -> tuple[bool, list, list]:
        """Whether merging makes the piece from its characters; what stands at its left and right end
        over time, from the single character up to the piece, with the rank that ends each."""
        if piece not in self.sides:
            made, parts = len(piece) < 2 or merged(piece, self.ranks) == [piece], {}
            if made and len(piece) > 1:
                todo = list(piece)
                while len(todo) > 1:
                    _, at = min((self.ranks.get(todo[i] + todo[i + 1], _NEVER), i) for i in range(len(todo) - 1))
                    parts[todo[at] + todo[at + 1]] = (todo[at], todo[at + 1])
                    todo[at : at + 2] = [todo[at] + todo[at + 1]]
            ends = []
            for side in (0, 1):
                line, now = [(piece, _NEVER)], piece
                while now in parts:
                    line.append((parts[now][side], self.ranks[now]))
                    now = parts[now][side]
                ends.append(line[::-1])
            self.sides[piece] = (made, ends[0], ends[1])
        return self.sides[piece]

    def _may_follow(self, left: str, right: str) -> bool:
        """Whether merging the joint text again gives these two pieces; or the right one, if there is none before."""
        (fine, _, x), (good, y, _) = self._sides(left), self._sides(right)
        got, i, j, rank = fine and good, 0, 0, self.ranks.get
        while got and left:
            (a, ends_a), (b, ends_b) = x[i], y[j]
            crossing = rank(a + b, _NEVER)
            if crossing < ends_a and crossing <= ends_b and crossing != _NEVER:
                got = False
            elif ends_a == ends_b == _NEVER:
                break
            elif ends_a <= ends_b:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= _KEEP:
            self.pairs.clear()
        self.pairs[left, right] = got
        return got

    def _shorter(self, piece: str) -> str | None:
        """The longest shorter piece that the piece begins with."""
        got = self.shorter.get(piece, "")
        if got == "":
            got = self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.v.ids), None)
        return got

    def _run(self, text: str, longest: list[int]) -> list[int]:
        """Ids of a stretch in which every character is a piece."""
        out: list[str] = []
        ids, pairs, failed, at, end, before = self.v.ids, self.pairs, 0, 0, len(text), ""
        piece: str | None = text[: longest[0]]
        while True:
            to = at + len(piece)
            if not failed >> to & 1:
                fits = pairs.get((before, piece))
                if fits or fits is None and self._may_follow(before, piece):
                    out.append(piece)
                    if to == end:
                        return [ids[p] for p in out]
                    before, at = piece, to
                    piece = text[at : at + longest[at]]
                    continue
            piece = self._shorter(piece)
            while piece is None:  # nothing leads on from here
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                before = out[-1] if out else ""
                piece = self._shorter(last)

    def segment(self, text: str) -> list[int]:
        """Ids of a stretch that merges don't cross."""
        longest = [0] * len(text)
        for last, size in self.automaton.iter(text):  # ends ascend, so the longest comes last
            longest[last - size] = size + 1
        if 0 not in longest:
            return self._run(text, longest)
        ids, at, n = [], 0, len(text)
        while at < n:
            to = at
            while to < n and longest[to]:
                to += 1
            if to > at:
                ids += self._run(text[at:to], longest[at:to])
            if to < n:
                ids += [self.v.bytes_[b] for b in text[to].encode()]
            at = to + 1
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text, with the end id; that alone for an empty one."""
        known, ids = self.known, []
        for part in self.segments(SPACE + text.replace(" ", SPACE)) if text else ():
            got = known.get(part)
            if got is None:
                got = self.older.get(part) or tuple(self.segment(part))
                if len(known) >= _KEEP:  # what is still met moves on to the new table
                    self.older, self.known = known, {}
                    known = self.known
                if len(part) <= 64:
                    known[part] = got
            ids += got
        ids.append(self.v.end)
        return ids


def decode_ids(ids: list[int], v: Vocabulary, parted: bool = True) -> str:
    """Text of the ids; control ids say nothing, a byte that is part of no character becomes U+FFFD."""
    try:
        if parted:  # control ids part runs of bytes
            raise ValueError
        text = b"".join(map(v.texts.__getitem__, ids)).decode()
    except ValueError:
        text, run = "", bytearray()
        for i in [*ids, v.end]:
            if i in v.byte_of:
                run += v.texts[i]
            else:
                text += _characters(bytes(run)) + v.texts[i].decode()
                run.clear()
    first = next((i for i in ids if i not in v.control), v.end)
    return text[1:] if text[:1] == " " and first not in v.byte_of and first != v.unknown else text


@lru_cache(65536)
def _characters(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                if len(run[at : at + n].decode()) == 1:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_MADE: dict[int, Encoder] = {}


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with column ``name`` computed from ``source`` by ``make()(column)`` on Arrow batches."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), work(batch.column(source))], names=[*kept, name])

    return df.mapInArrow(run, schema)


def encode(spark: SparkSession, df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an array of ids, exactly those of the library (end id, no start id, no sampling).

    Null and empty texts give the end id alone. All other columns stay; one named like
    ``ids_col`` is replaced. The vocabulary (its size is that of the model) goes to the
    executors once; texts are never split over rows, and a worker's tables are bounded.
    """
    shared, mark = spark.sparkContext.broadcast(Vocabulary.load(model)), hash(model)

    def make():
        if mark not in _MADE:
            _MADE[mark] = Encoder(shared.value)
        one = _MADE[mark].encode

        def work(texts: pa.Array) -> pa.Array:
            values, ends = array("i"), [0]
            for text in texts:
                values.extend(one(text.as_py()))
                ends.append(len(values))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32), pa.int32()))

        return work

    return _with_column(df, text_col, ids_col, T.ArrayType(T.IntegerType()), make)


def decode(spark: SparkSession, df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``; null or empty arrays give an empty text."""
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))

    def make():
        v = shared.value

        def work(rows: pa.ListArray) -> pa.Array:
            ends = np.cumsum(rows.value_lengths().fill_null(0).to_numpy()).tolist()
            values = rows.flatten().to_numpy()
            # places of control ids; one at the end of a row is the usual one
            inner = np.zeros(len(values) + 1, np.int64)
            np.cumsum(np.isin(values, list(v.control)), out=inner[1:])
            return pa.array([decode_ids(values[a:b].tolist(), v, inner[max(a, b - 1)] > inner[a]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.string())

        return work

    return _with_column(df, ids_col, text_col, T.StringType(), make)


def token_digests(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the number of ids and SHA-256 digests of the ids and of the decoded text."""
    return df.withColumns({
        "n_tokens": F.size(ids_col).cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(" ", F.col(ids_col).cast("array<string>")), 256),
        "decoded_sha256": F.sha2(text_col, 256),
    })
