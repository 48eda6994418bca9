"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A text runs through in pieces of bounded size: it is cut where neither normalisation nor the split pattern can see
across, split into words, each word goes symbol by symbol through the transducer, and ids leave as soon as they are
stable; their digest, and the decoded text's, are taken on the way. What is held does not grow with text or word (but
for the text itself, which is one value of a row, and the ids where they are asked for).

Encoding. For every prefix of a word there is exactly one last token, and it is the only token that is compatible with
the last token of what precedes it (two adjacent tokens are compatible when the merge list, applied to both together,
leaves them apart). The transducer keeps, for the places it may still come back to, that last token; once all of them
lead back through the same token boundary, whatever follows cannot change what lies before it, and it is emitted.
``lookahead`` is the bound that the merge list itself implies (number of merges times the longest token, Berglund and
van der Merwe 2023); what the transducer holds stays under it, and in practice under a few tokens, for words of any
length. A word's end also ends the lookahead, so what the transducer emitted for a word is remembered, in tables of
bounded bytes that a worker keeps until it gets a task of another stage.

Decoding. Ids become bytes and bytes become text in an incremental state machine, which holds back an unfinished
character; invalid bytes become U+FFFD. For a tokeniser without a decoder a blank goes before each token but the first,
as its library has it; for a byte-level decoder the bytes are those that the token's characters stand for.

A tokeniser file whose model, normaliser, pre-tokeniser, post-processor, decoder or added tokens say anything else than
what is implemented here is refused (ValueError).

Defined results: null text counts as empty and gives no tokens; strings of special tokens inside a text are those
tokens; each row gets its result, repeated rows and repeated or null keys too; an empty table gives an empty result;
only key and text of the table are read, so its other columns may have any names. The tokeniser file is read by the
driver and broadcast (its size is that of one vocabulary, a few MB).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, map_arrow, read, slices

#: Bytes of remembered words (and as many of older ones), pairs of tokens whose fit is remembered, characters of a piece.
REMEMBERED, PAIRS, PIECE = 24_000_000, 250_000, 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Pairs of token ids as one number; ends a word in the automaton.
SHIFT, END = 24, "\uffff"
_LOW = (1 << SHIFT) - 1


class Merges:
    """Vocabulary and merge list of one tokeniser, as the transducer needs them: tokens are their ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(ids.values(), default=0) + 1
        self.made, self.halves, self.length = [-1] * size, [(0, 0)] * size, [0] * size
        self.rank: dict[int, int] = {}
        # all tokens that end at a place are found in one walk, the longest first
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        tokens = byte_alphabet() + [c + suffix for c in byte_alphabet()]
        for r, (a, b) in enumerate(pairs):
            t, x, y = ids[a + b], ids[a], ids[b]
            if self.made[t] >= 0 or size > _LOW:
                raise ValueError("the merge list must make each token once")
            self.made[t], self.halves[t], self.rank[x << SHIFT | y] = r, (x, y), r
            tokens.append(a + b)
        if any(self.made[h] >= self.made[t] for t in self.rank and range(size) if self.made[t] >= 0 for h in self.halves[t]):
            raise ValueError("the merge list must make each token after its halves")
        for t in tokens:
            plain = t[: -len(suffix)] if suffix and t.endswith(suffix) else t
            self.length[ids[t]] = len(plain)
            self.automaton.add_word(plain + END if plain != t or not suffix else plain, len(plain) << SHIFT | ids[t])
            if not suffix:
                self.automaton.add_word(plain, len(plain) << SHIFT | ids[t])
        self.automaton.make_automaton()
        self.longest = max(self.length)
        self.lookahead = len(pairs) * self.longest
        self.known: dict[int, bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens apart.

        Undo the merges of both sides in reverse order of time. Whenever the pieces that face each other could merge
        sooner than either was merged away (on equal ranks the left merge comes first), the boundary would be gone.
        """
        rank, made, halves = self.rank, self.made, self.halves
        a, b, ends_a, ends_b = left, right, len(rank), len(rank)
        while True:
            r = rank.get(a << SHIFT | b)
            if r is not None and r < ends_a and r <= ends_b:
                out = False
                break
            made_a, made_b = made[a], made[b]
            if made_a < 0 and made_b < 0:
                out = True
                break
            if made_a > made_b:
                a, ends_a = halves[a][1], made_a
            else:
                b, ends_b = halves[b][0], made_b
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[left << SHIFT | right] = out
        return out


class Transducer:
    """Feed the symbols of one word, in pieces of any size; ids come out once they are stable."""

    #: Symbols between two looks at what is stable.
    EVERY = 256

    def __init__(self, merges: Merges, every: int = EVERY):
        self.m, self.every = merges, every
        self.held = ""  # symbols from the last emitted boundary on
        self.last = [-1]  # the last token of each prefix of held
        self.before = -1  # the token before held
        self.most = 0

    def feed(self, symbols: str, ends: bool = False) -> list[int]:
        """The tokens that have become stable; ``ends``: the last of these symbols (one at least) ends the word."""
        m, out = self.m, []
        known, apart = m.known, m.apart
        whole, last, before = self.held + symbols, self.last, self.before
        n, base, done, check = len(whole), 0, len(last) - 1, self.every
        if done >= check:
            check += done
        whole_word = n if ends else n + 1
        for stop, found in m.automaton.iter(whole + END if ends else whole):
            stop += 1
            if stop <= done or stop == whole_word:
                continue  # has its last token already; or only the word's end counts there
            t = found & _LOW
            if stop > n:
                stop = n
            start = stop - (found >> SHIFT)
            if start < base:
                continue
            left = last[start - base] if start > base else before
            if left >= 0:
                fits = known.get(left << SHIFT | t)
                if not (apart(left, t) if fits is None else fits):
                    continue
            if stop != done + 1:
                raise ValueError("the merge list splits no text so")
            last.append(t)
            done = stop
            if stop >= check and stop < n:
                place = self._stable(last)
                if place:
                    tokens = self._tokens(last, place)
                    out += tokens
                    before = tokens[-1]
                    last = [-1, *last[place + 1 :]]
                    base += place
                check = stop + self.every
        if done != n:
            raise ValueError("the merge list splits no text so")
        if ends:
            out += self._tokens(last, n - base)
            self.held, self.last, self.before = "", [-1], -1
        else:
            self.held, self.last, self.before = whole[base:], last, before
        return out

    def _stable(self, last: list[int]) -> int:
        """The farthest boundary through which every place leads that a later symbol may come back to."""
        n, longest, length = len(last) - 1, self.m.longest, self.m.length
        self.most = max(self.most, n)
        if n > self.m.lookahead + longest + self.every:
            raise AssertionError("the lookahead is not sufficient")
        common: set[int] = set()
        for k, place in enumerate(range(max(1, n - longest), n + 1)):
            back = set()
            while place > 0:
                back.add(place)
                place -= length[last[place]]
            common = back if not k else common & back
        return max(common, default=0)

    def _tokens(self, last: list[int], place: int) -> list[int]:
        out, length = [], self.m.length
        while place > 0:
            out.append(last[place])
            place -= length[last[place]]
        return out[::-1]


class Decoder:
    """Ids to bytes to text, piece by piece."""

    def __init__(self, spec: dict):
        self.joined = spec.get("decoder") is None
        strings = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
        as_bytes = (lambda t: b" " + t.encode()) if self.joined else (lambda t: bytes(bytes_of[c] for c in t) if all(c in bytes_of for c in t) else t.encode())
        self.bytes_of = {i: as_bytes(t) for i, t in strings.items()}
        self.start()

    def start(self) -> Decoder:
        """Ready for a new text."""
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False
        return self

    def token_bytes(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in struct.unpack(f"<{len(packed) // 4}I", packed)])

    def feed(self, data: bytes) -> str:
        """What these bytes add to the text."""
        if self.joined and not self.begun and data:
            self.begun = True
            data = data[1:]
        return self.utf8.decode(data)

    def end(self) -> str:
        return self.utf8.decode(b"", True)


class _Table(dict):
    """Remembered results of a function, in two generations of bounded bytes: when one is full the older is dropped."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older, self.bytes = make, most, {}, 0

    def __missing__(self, key):
        if self.bytes >= self.most:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        out = self.older.get(key)
        out = self.make(key) if out is None else out
        if len(key) < 1000:
            self[key] = out
            self.bytes += len(key) + len(out) + 200
        return out


@cache
def _joining() -> frozenset[str]:
    """Characters that normalisation may join to what precedes them, or move."""
    hangul = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    pairs = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
    second = {chr(int(p.split()[1], 16)) for p in pairs if p and p[0] != "<" and " " in p}
    return frozenset(second | {chr(c) for c in hangul})


def safe_cut(text: str, at: int, least: int) -> int:
    """The last place up to ``at`` and beyond ``least`` where normalisation cannot see across; the next one after it, if there is none."""
    free = lambda k: text[k] < "\u0300" or not (unicodedata.combining(text[k]) or text[k] in _joining())
    for k in range(at, least, -1):
        if free(k):
            return k
    while at < len(text) and not free(at):
        at += 1
    return at


# The split pattern, normaliser and pre-tokeniser that a tokeniser file must have.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"normalized": False, "special": True, "lstrip": False, "rstrip": False, "single_word": False}


def check(spec: dict) -> None:
    """Refuse a tokeniser file that asks for anything else than what is done here."""
    wanted = [("normalizer", spec.get("normalizer"), NORMALIZER), ("pre_tokenizer", spec.get("pre_tokenizer"), PRE_TOKENIZER), ("post_processor", spec.get("post_processor"), None)]
    wanted += [(f"model.{k}", spec["model"].get(k, v), v) for k, v in MODEL.items()]
    wanted += [(f"added_tokens.{k}", a.get(k, v), v) for a in spec["added_tokens"] for k, v in ADDED.items()]
    for name, has, want in wanted:
        if has != want:
            raise ValueError(f"{name} of the tokeniser file is {has!r}; only {want!r} is implemented")
    if (spec.get("decoder") or {"type": "ByteLevel"})["type"] != "ByteLevel":
        raise ValueError("only a byte-level decoder, or none, is implemented")
    if any(not a["content"] or regex.search(r"\s", a["content"]) for a in spec["added_tokens"]):
        raise ValueError("added tokens must hold no blanks")


class Codec:
    """Whole texts to ids and back, for tokeniser files that ``check`` admits."""

    SPLIT = regex.compile(SPLIT)
    # the same for lower-case ASCII texts
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
    LETTERS, OTHERS = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*")

    def __init__(self, source: bytes, piece: int = PIECE):
        self.spec, self.piece = json.loads(source), piece
        check(self.spec)
        self.merges = Merges(self.spec)
        self.alphabet = byte_alphabet()
        self.added = {a["content"]: a["id"] for a in self.spec["added_tokens"]}
        self.longest_mark = max(map(len, self.added), default=1)
        self.marks = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.decoder = Decoder(self.spec)
        self.packed, self.shown = _Table(self._word, REMEMBERED), _Table(self.decoder.token_bytes, REMEMBERED // 2)

    def symbols(self, word: str) -> str:
        return "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")])

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        return self.pack(Transducer(self.merges).feed(self.symbols(word), True))

    @staticmethod
    def normal(text: str) -> str:
        # blanks separate words whatever they are, so they need no replacement
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # one character at a time where Python's lower() looks at a word's end
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        return (self.ASCII if text.isascii() else self.SPLIT).findall(text)

    def pieces(self, text: str, at: int, end: int) -> Iterator[str]:
        """text[at:end], normalised, in pieces."""
        while at < end:
            stop = min(end, safe_cut(text, at + self.piece, at)) if end - at > self.piece else end
            yield self.normal(text[at:stop])
            at = stop

    def words_end(self, text: str) -> int:
        """A place in text (more of it may follow) where its words up to there are whole; 0 if none is sure."""
        if (blank := max(text.rfind(" "), text.rfind("\n"))) > 0:
            return blank
        # all words but the last three stand, whatever follows: a contraction has three characters
        found = [m.start() for m in (self.ASCII if text.isascii() else self.SPLIT).finditer(text)]
        return found[-3] if len(found) > 3 else 0

    def plain(self, text: str, at: int, end: int) -> Iterator[list[bytes]]:
        """The ids of text[at:end], which holds no special token: those of each word, or of a part of a very long one."""
        packed_words = lambda part: list(map(self.packed.__getitem__, self.split(part)))
        pieces, rest = self.pieces(text, at, end), ""
        for piece in pieces:
            rest += piece
            if len(rest) < self.piece:
                continue
            if whole := self.words_end(rest):
                yield packed_words(rest[:whole])
                rest = rest[whole:]
            if len(rest) < self.piece:
                continue
            # a word that fills a piece goes on as long as its kind of characters does
            upto = self.SPLIT.match(rest).end() if self.SPLIT.match(rest) else 0
            if upto < len(rest):
                yield packed_words(rest[:upto])
                rest = rest[upto:]
                continue
            more, word, held, rest = (self.LETTERS if regex.match(r"\p{L}", rest) else self.OTHERS), Transducer(self.merges), rest, ""
            for piece in pieces:
                upto = more.match(piece).end()
                if upto:
                    yield [self.pack(word.feed(self.symbols(held)))]
                    held = piece[:upto]
                rest = piece[upto:]
                if rest:
                    break
            yield [self.pack(word.feed(self.symbols(held), True))]
        if rest:
            yield packed_words(rest)

    def encode(self, text: str) -> Iterator[list[bytes]]:
        """The ids of a text, some words (or special tokens) at a time: packed little-endian unsigned 32-bit integers."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield from self.plain(text, at, m.start())
            yield [struct.pack("<I", self.added[m[0]])]
            at = m.end()
        yield from self.plain(text, at, len(text))

    def decode(self, packed: Iterable[list[bytes]]) -> Iterator[str]:
        """The text of ids as ``encode`` gives them, piece by piece, as the library's decode has it."""
        one = self.decoder.start()
        for some in packed:
            yield one.feed(b"".join(map(self.shown.__getitem__, some)))
        yield one.end()


def encode_table(df: DataFrame, key: str, text: str, tokenizer: str, ids: bool = False) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256[, ids])`` of every row's whole text; a map, no exchange."""
    with open(tokenizer, "rb") as f:
        source = f.read()
    check(json.loads(source))
    sent = df.sparkSession.sparkContext.broadcast(source)
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches):
        codec = kept("codec", lambda: Codec(sent.value))
        for part in slices(batches, "text", 4 << 20):
            counts, packed, digests, decoded = [], [], [], []
            for t in part.column("text"):
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

                def seen(chunks):
                    nonlocal n
                    for some in chunks:
                        row = b"".join(some)
                        n += len(row) // 4
                        of_ids.update(row)
                        if ids:
                            packed.append(row)
                        yield some

                for shown in codec.decode(seen(codec.encode(t.as_py()))):
                    of_text.update(shown.encode("utf-8", "surrogatepass"))
                counts.append(n)
                digests.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
            columns = [part.column("key"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
            if ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return map_arrow(rows, run, schema).withColumnRenamed("key", key)


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "") -> DataFrame:
    if not tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encode_table(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer)
