"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary is that of a tokenizer file whose words end in a suffix: text is composed (NFC), white
space dropped, lower-cased and cut into pieces; a piece's UTF-8 bytes are shown as one printable
character each, and its last character also carries the suffix. An Aho-Corasick pass over a piece
finds the longest token from every place. The encoder takes it if merging would really leave
a boundary between it and the token before, else the next shorter token, and steps back where none
fits; places from which nothing fits are marked, so each is tried once. That gives exactly the tokens
of merging by rank, in time linear in the piece. Decoding copies each id's span of one buffer that
holds all tokens' texts; the file has no decoder, so texts are joined by spaces.

Strings of the file's special tokens are cut out of the raw text first and become their ids.

Defined results: null is the empty text, which has no tokens and decodes to the empty text; texts of any
length are encoded whole; every row is encoded by itself, so repeated rows and ids are equal.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the tokenizer's pattern engine has it (the Unicode property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Python takes these for white space too.
SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE_RE = regex.compile(f"[{WHITE}]+")
# The tokenizer's engine follows Unicode 16 in its classes of letters and numbers, and 17 in
# lower case. Below are the code points in which the Python libraries differ from that.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    "\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    "\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
LOWER[ord("Σ")] = ord("σ")  # each character by itself: no final sigma


#: Entries that a task keeps of pieces already encoded, and of pairs already judged.
CACHED = 300_000


def byte_signs() -> list[str]:
    """The printable character of each byte: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Bpe:
    """Tables of one tokenizer file, and the caches of one task."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{LATER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER}]]")
        self.pieces = regex.compile(pattern.replace(r"\s", WHITE), regex.VERSION1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.signs = byte_signs()
        self.last = {c: chr(0x1000 + ord(c)) for c in self.signs}  # a character that carries the suffix

        size = max([*vocab.values(), *self.special.values()]) + 1
        self.texts = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.texts[i] = token.encode()
        self.order, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        symbols: dict[int, str] = {}
        for c in self.signs:
            symbols[vocab[c]] = c
            symbols[vocab[c + suffix]] = self.last[c]
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            symbols[i] = symbols[x] + symbols[y]
            self.order[i], self.left[i], self.right[i] = rank, x, y
            self.merged[x, y] = i
        by_symbols = {s: i for i, s in symbols.items()}
        self.length, self.shorter = [0] * size, [-1] * size
        self.automaton = ahocorasick.Automaton()
        for i, s in symbols.items():
            self.length[i] = len(s)
            self.shorter[i] = next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), -1)
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        # the offset table: each token's text and a space, one after the other
        self.buffer = np.frombuffer(b"".join(t + b" " for t in self.texts), np.uint8)
        self.span = np.array([len(t) + 1 for t in self.texts], np.int64)
        self.start = np.cumsum(self.span) - self.span

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between tokens a and b: undo their merges from the
        last on, and see whether a pair across the boundary would have been merged before."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, before, fits = a, b, len(self.merged), True
        while True:
            across = self.merged.get((x, y))
            if across is not None and self.order[across] < before:
                fits = False
                break
            if self.order[x] > self.order[y]:
                before, x = self.order[x], self.right[x]
            elif self.order[y] >= 0:  # of two equal merges the one to the left comes first
                before, y = self.order[y] + 1, self.left[y]
            else:
                break
        if len(self.fits) >= CACHED:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        signs = [self.signs[b] for b in piece.encode("utf-8")]
        signs[-1] = self.last[signs[-1]]
        text = "".join(signs)
        longest = [0] * len(text)
        for end, token in self.automaton.iter(text):  # ends rise, so the longest comes last
            longest[end + 1 - self.length[token]] = token
        out: list[int] = []
        at, token, dead = 0, longest[0], bytearray(len(text) + 1)
        while True:
            while token >= 0:
                end = at + self.length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
                continue
            out.append(token)
            at = end
            if at == len(text):
                return out
            token = longest[at]

    def _chunk(self, chunk: str) -> bytes:
        """Ids, 4 bytes each, of text without white space."""
        flat = unicodedata.normalize("NFC", chunk).translate(LOWER).lower()
        ids = [i for piece in self.pieces.findall(flat) for i in self.encode_piece(piece)]
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        chunks = WHITE_RE.split(text) if SEPARATORS.search(text) else text.split()
        known = self.known
        if len(known) >= CACHED:
            known.clear()
        for chunk in set(chunks).difference(known):
            known[chunk] = self._chunk(chunk)
        return b"".join(map(known.__getitem__, chunks))

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.special_re is None or not self.special_re.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = (np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.special_re.split(text))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text."""
        span = self.span[ids]
        ends = np.cumsum(span)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - span), span)
        return self.buffer[at[:-1]].tobytes()


@lru_cache(maxsize=2)
def load(text: str) -> Bpe:
    return Bpe(text)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, [ids, decoded,] n_tokens, ids_sha256, decoded_sha256) of each row.

    The file is read on the driver and broadcast: its size is that of the vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    extra = [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if with_ids else []
    names = ["id", *[n for n, _ in extra], "n_tokens", "ids_sha256", "decoded_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        for batch in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            for x in batch.column(1):
                ids = bpe.encode(x.as_py())
                decoded = bpe.decode(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(decoded).hexdigest())
                if extra:
                    kept.append((ids.tolist(), decoded.decode()))
            more = [pa.array([k[i] for k in kept], t) for i, (_, t) in enumerate(extra)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(task, f"id {kind}, {'ids array<bigint>, decoded string, ' if with_ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def encode_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document's token count and digests."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
