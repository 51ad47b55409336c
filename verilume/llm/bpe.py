"""BPE encoding by content-defined chunk reuse, and decoding.

A rolling hash over the last WINDOW bytes cuts every text into chunks, at the same places wherever the same passage
stands, so that copies, near copies and repeated passages share chunks. A chunk is encoded once and its ids are kept in the
worker's bounded store; within a new chunk, words that were met before are taken from a bounded dictionary as well. A cut may
fall inside a word: the ids on both sides of each join are then dropped back to the nearest white space, the gap is encoded
anew together with one word of each side, and the result counts only if it begins and ends with exactly the ids that are
kept there; if not, the text is encoded as one piece. White space separates words in these tokenizers' pre-tokenization and
normalisation, so ids of separated words don't depend on each other; `separable` checks that of a tokenizer.

Reuse is per worker, not global: shipping each chunk to one owner and its ids back would move more bytes than the text has.

Defined results: a null text counts as empty and gives no ids; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilume.llm import textnum
from verilume.llm.common import kept, map_texts, step

WINDOW, MASK_BITS = 16, 11
#: Bounds of a worker's memory, in bytes: the stores of words, bare words and chunks; what an entry takes besides its key and value.
MAX_WORDS, MAX_BARE, MAX_STORE, ENTRY = 32 << 20, 40 << 20, 12 << 20, 170
#: Bytes of text at a time.
BATCH = 1 << 20
#: Punctuation that a word may end with; each run of it is one pre-token.
TAIL = b".,!|%$#*&;:?"

_STEP = 0x9E3779B97F4A7C15
_GEAR = textnum.mix(np.arange(1, 257, dtype=np.uint64))


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions before which the rolling hash of the last WINDOW bytes asks for a cut; never inside a character."""
    h, span = _GEAR[buf], 1
    while span < WINDOW:
        h[span:] += h[:-span] * np.uint64(pow(_STEP, span, 1 << 64))
        span *= 2
    at = np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + 1
    at = at[at < len(buf)]
    return at[(buf[at] & 0xC0) != 0x80]


def separable(tokenizer) -> bool:
    """Whether white space always separates: no ids for white space, and none that depend on a neighbouring word."""
    probe = ["alpha", "Beta's", "42", "<x>", "é", "...", "ab́"]
    each = [i for w in probe for i in tokenizer.encode(w, add_special_tokens=False).ids]
    return all(tokenizer.encode(sep.join(probe), add_special_tokens=False).ids == each for sep in (" ", "\n", "\t", "\r", "\x0b", "\x0c", "  \n"))


def _cost(key: bytes, value) -> int:
    return ENTRY + len(key) + (len(value) if isinstance(value, bytes) else sum(ENTRY // 2 + len(x or b"") for x in value))


class Recent:
    """A dictionary of two generations of `limit` / 2 bytes each: when the young one is full, the old one goes. An entry that is larger
    than a generation isn't kept."""

    def __init__(self, limit: int):
        self.limit, self.size = limit // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        cost = _cost(key, value)
        if cost > self.limit:
            return
        if self.size + cost > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += cost


class Encoder:
    """One worker's tokenizer with its bounded stores."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_space = separable(self.tokenizer)
        self.by_tail = self.by_space and self._tail_separates()
        self.words, self.bare, self.chunks = Recent(MAX_WORDS), Recent(MAX_BARE), Recent(MAX_STORE)
        self.tokens = None
        if self.tokenizer.decoder is None:
            self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def _tail_separates(self) -> bool:
        """Whether letters and the punctuation after them are encoded apart, and capitals (up to U+00FF) as small letters."""
        ids = [self.ids([w])[0] for w in (b"Straw,!", b"straw", b",!", "É.".encode(), "é".encode(), b".")]
        return ids[0] == ids[1] + ids[2] and ids[3] == ids[4] + ids[5]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _bare(self, word: bytes) -> tuple[bytes, bytes]:
        """The word as letters and a tail of punctuation, each with ids of its own; (word, b"") if it isn't that plain."""
        stem = word.rstrip(TAIL)
        if self.by_tail and stem:
            text = stem.decode("utf-8", "replace")
            if text.isalpha() and max(text) <= "\xff":
                return text.lower().encode(), word[len(stem) :]
        return word, b""

    def encode_words(self, pieces: list[bytes]) -> list[bytes]:
        out = list(map(self.words.young.get, pieces))
        if None in out:
            missing = {w: self.words.get(w) for w, i in zip(pieces, out, strict=True) if i is None}
            new_words = [w for w, i in missing.items() if i is None]
            pairs = [self._bare(w) for w in new_words]
            need = dict.fromkeys(x for pair in pairs for x in pair if x)
            known = {x: self.bare.get(x) for x in need}
            if new := [x for x, i in known.items() if i is None]:
                for x, i in zip(new, self.ids(new), strict=True):
                    known[x] = i
                    self.bare.put(x, i)
            known[b""] = b""
            for w, (stem, tail) in zip(new_words, pairs, strict=True):
                missing[w] = known[stem] + known[tail]
                self.words.put(w, missing[w])
            out = [missing[w] if i is None else i for w, i in zip(pieces, out, strict=True)]
        return out

    def chunk(self, part: bytes) -> tuple:
        """(head, first inner word, ids of the inner words, last inner word, tail); (part,) if it has no white space."""
        key = hashlib.blake2b(part, digest_size=16).digest()
        found = self.chunks.get(key)
        if found is None:
            found = self._new_chunk(part)
            self.chunks.put(key, found)
        return found

    def _new_chunk(self, part: bytes) -> tuple:
        pieces = part.split()
        head = pieces.pop(0) if pieces and not part[:1].isspace() else b""
        if head == part:
            return (part,)
        tail = pieces.pop() if pieces and not part[-1:].isspace() else b""
        return head, pieces[0] if pieces else None, b"".join(self.encode_words(pieces)), pieces[-1] if pieces else None, tail

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The ids of each text, little-endian 32 bits each."""
        raw, at = buf.tobytes(), cuts(buf)
        texts = [raw[i:j] for i, j in zip(offs[:-1], offs[1:], strict=True)]
        if not self.by_space:
            return self.ids(texts)
        parts: list[list] = []
        joins: list[tuple[int, int, bytes | None, bytes, bytes | None]] = []
        lo, hi = np.searchsorted(at, offs[:-1] + WINDOW, side="left"), np.searchsorted(at, offs[1:], side="left")
        for k in range(len(texts)):
            out: list = []
            carry, before, joined = b"", None, False
            edges = [int(offs[k]), *at[lo[k] : hi[k]].tolist(), int(offs[k + 1])]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                found = self.chunk(raw[i:j])
                if len(found) == 1:
                    carry, joined = carry + found[0], joined or i > edges[0]
                    continue
                head, first, ids, last, tail = found
                if carry + head:
                    if joined or carry:
                        joins.append((k, len(out), before, carry + head, first))
                        out.append(None)
                    else:
                        out.append(self.encode_words([head])[0])
                out.append(ids)
                carry, before, joined = tail, last, False
            if carry:
                out.append(self.encode_words([carry])[0])
            parts.append(out)
        whole = self._repair(parts, joins)
        for k, ids in zip(whole, self.ids([texts[k] for k in whole]) if whole else [], strict=True):
            parts[k] = [ids]
        return [b"".join(p) for p in parts]

    def _repair(self, parts: list[list], joins: list) -> list[int]:
        """Fill the gaps at the joins; the texts whose joins don't agree with what is kept beside them."""
        if not joins:
            return []
        windows = self.ids([b" ".join(w for w in join[2:] if w is not None) for join in joins])
        beside = self.encode_words([w or b"" for join in joins for w in (join[2], join[4])])
        bad = set()
        for (k, at, *_), got, left, right in zip(joins, windows, beside[::2], beside[1::2], strict=True):
            if len(got) >= len(left) + len(right) and got.startswith(left) and got.endswith(right):
                parts[k][at] = got[len(left) : len(got) - len(right)]
            else:
                bad.add(k)
        return sorted(bad)

    def decode(self, ids: bytes) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()


def worker(path: str) -> Encoder:
    encoders = kept("bpe", dict)
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each whole text, as the tokenizer file at `path` gives them."""

    def run(batch: pa.RecordBatch):
        ids = worker(path).encode(*textnum.text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, ids binary", limit=BATCH, owner="bpe")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the decoded text in the column decoded."""

    def run(batches):
        for batch in batches:
            texts = [worker(path).decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(step(run, "bpe"), "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of each whole text: encode and decode in one pass, so that a task needs one Python worker."""

    def run(batch: pa.RecordBatch):
        coder = worker(path)
        ids = coder.encode(*textnum.text_bytes(batch.column("text")))
        texts = pa.array([coder.decode(x) for x in ids], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), texts], ["doc_id", "ids", "decoded"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded string", limit=BATCH, owner="bpe")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and name both results by their digests."""
    return round_trip(docs, path).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
