"""BPE encoding and decoding with a pair occurrence index.

``encode(docs)`` adds ids and their decoded form to every row. Inside a task the distinct, not yet
known chunks of a batch are laid out as one symbol sequence; every adjacent pair is indexed to all its
positions, active ranks are applied in ascending order, and each merge updates the lists of the pairs
beside it. Chunk results are remembered within the task, so a word costs its merges once.

Word classes and lower cases are those of the library the vocabulary is for (Unicode 16 letters and digits, Unicode 17 cases), whatever version Python and
its regular expressions have.

Defined results: null or empty text gives no ids and an empty decoded text; repeated rows are encoded
alike; an empty table gives an empty result; other columns of the input pass through only by ``keep``.
The memo of a task is emptied beyond ``memo_chunks`` entries, which bounds memory and changes no result.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from augury.llm.common import small_batches, texts

#: Characters that str.split() cuts at but the vocabulary's white-space class doesn't hold.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
CHUNK = regex.compile(r"[^\s\x85]+" if regex.match(r"\s", "\x1c") is None else r"(?:[^\s]|[\x1c-\x1f])+")

# Hexadecimal ranges of letters and digits newer than Unicode 16, which the vocabulary's word classes hold for neither.
TOO_NEW = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
# Lower cases (first, last, distance) of Unicode 16 and 17, which str.lower() may not know yet.
LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
LOWER_OF = {c: c + by for first, last, by in LOWER for c in range(first, last + 1)}


def pinned(pattern: str) -> str:
    """The pattern with its letters and digits held to those up to Unicode 16, whatever version the regular expressions know."""
    late = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in TOO_NEW)
    swaps = {r"[\p{L}]": rf"[\p{{L}}--[{late}]]", r"[\p{N}]": rf"[\p{{N}}--[{late}]]", r"[^\s\p{L}\p{N}]": rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]"}
    parts = regex.split("|".join(f"({regex.escape(k)})" for k in swaps), pattern)
    return "(?V1)" + "".join(swaps.get(x, x) for x in parts if x)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest for code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, free = [""] * 256, iter(range(256, 512))
    for b in range(256):
        out[b] = chr(b if b in set(plain) else next(free))
    return out


class PairIndexBPE:
    """One vocabulary file of the ``tokenizers`` JSON form: byte-level BPE with a word-end suffix."""

    def __init__(self, path: str, memo_chunks: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ascii_words, self.words = regex.compile(pattern), regex.compile(pinned(pattern))
        self.rank: dict[tuple[int, int], int] = {}
        self.pair: list[tuple[int, int]] = []
        self.made: list[int] = []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[key := (vocab[a], vocab[b])] = r
            self.pair.append(key)
            self.made.append(vocab[a + b])
        self.token = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.memo: dict[str, bytes] = {}
        self.memo_chunks = memo_chunks
        self.forget()

    def forget(self) -> None:
        """Empty the memo, but for the special tokens: cut out beforehand, they occur in no other chunk."""
        self.memo.clear()
        self.memo.update((t, i.to_bytes(4, "little")) for t, i in self.special.items())

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. One pair index over all words; a gap symbol of -1 parts them."""
        sym: list[int] = [-1]
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend([self.inner[c] for c in w[:-1]])
            sym.append(self.last[w[-1]])
            sym.append(-1)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        at: dict[int, list[int]] = {}
        rank = self.rank.get
        for i in range(1, n - 1):
            r = rank((sym[i], sym[i + 1]))
            if r is not None:
                at.setdefault(r, []).append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b = self.pair[r]
            new = self.made[r]
            for i in sorted(at.pop(r)):
                j = right[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, -2
                k = right[i] = right[j]
                left[k] = i
                for p, q in ((left[i], i), (i, k)):
                    s = rank((sym[p], sym[q]))
                    if s is not None:
                        if s in at:
                            at[s].append(p)
                        else:
                            at[s] = [p]
                            heapq.heappush(active, s)
        out = []
        for s in starts:
            ids = []
            while (x := sym[s]) >= 0:
                ids.append(x)
                s = right[s]
            out.append(ids)
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks (runs without white space) that the memo doesn't have."""
        cut = []
        for c in chunks:
            if c.isascii():
                cut.append(self.ascii_words.findall(c.lower()))
            else:
                cut.append(self.words.findall(unicodedata.normalize("NFC", c).replace("Σ", "σ").lower().translate(LOWER_OF)))
        known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in cut for w in ws))}
        ids = [array.array("I", x).tobytes() for x in self.merge([w.encode() for w in known])]
        for c, ws in zip(chunks, cut, strict=True):
            self.memo[c] = b"".join([ids[known[w]] for w in ws])

    def split(self, text: str) -> list[str]:
        return CHUNK.findall(text) if ODD_SPACE.search(text) else text.split()

    def encode_batch(self, rows: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for t in rows:
            if self.special_at is not None and "<|" in t:
                row, end = [], 0
                for m in self.special_at.finditer(t):
                    row += [*self.split(t[end : m.start()]), m[0]]
                    end = m.end()
                parts.append(row + self.split(t[end:]))
            else:
                parts.append(self.split(t))
        memo = self.memo
        fresh = {c for row in parts for c in row if c not in memo}
        if fresh and len(memo) + len(fresh) > self.memo_chunks:
            self.forget()
            fresh = {c for row in parts for c in row if c not in memo}
        if fresh:
            self.learn(list(fresh))
        return [b"".join([memo[c] for c in row]) for row in parts]

    def decode(self, ids: bytes) -> str:
        """Token strings parted by spaces: what a vocabulary file without a decoder section asks for."""
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def loaded(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens and either ids (binary, little-endian uint32) and decoded, or (``digests``) their SHA-256.

    ``vocabulary`` is the path of a vocabulary file that every executor has (an installed package's data).
    """
    fields = [f for f in docs.select(*keep).schema.fields]
    more = [("n_tokens", T.LongType())] + ([("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.BinaryType()), ("decoded", T.StringType())])
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for b in small_batches(batches, "__text"):
            ids = bpe.encode_batch(texts(b, "__text"))
            out = [b.column(c) for c in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64())]
            decoded = map(bpe.decode, ids)
            if digests:
                out += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
            else:
                out += [pa.array(ids, pa.binary()), pa.array(list(decoded), pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
