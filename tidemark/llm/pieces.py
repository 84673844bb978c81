"""SentencePiece BPE by a table of prefixes.

For each prefix of a text the table stores its unique last token: of the pieces that end there (an Aho-Corasick automaton
lists them) the one that forms a compatible pair with the last token of the prefix it starts after, that is, a pair that
the merges leave as it is. The ids of the whole text are then read off backwards, from the last token of the whole text to
the last token of what stands before it.

No piece reaches from another character into a white space mark, so a text is encoded run by run, each run being white
space marks and what follows them; short runs are remembered, since words repeat."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Runs remembered by a worker, the longest of them, and compatible pairs remembered.
RUNS, LONGEST_RUN, PAIRS = 1 << 19, 48, 1 << 20


class Runs(dict):
    """Run -> (its ids joined by spaces, how many, what they decode to)."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table

    def __missing__(self, run: str) -> tuple[str, int, str]:
        ids = self.table.encode_run(run)
        found = (" ".join(map(str, ids)), len(ids), self.table.pieces_of(ids))
        if len(run) <= LONGEST_RUN:
            if len(self) >= RUNS:
                self.clear()
            self[run] = found
        return found


class PieceTable:
    """The pieces of a BPE model, and what an encoder needs of them."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a BPE model that leaves texts as they are is asked for")
        if spec.treat_whitespace_as_suffix or not norm.add_dummy_prefix:
            raise ValueError("a model that puts white space before words is asked for")
        self.byte_fallback, self.bytes, self.control = spec.byte_fallback, {}, set()
        self.text, self.score, self.id, self.unk = [], [], {}, 0
        for i, p in enumerate(proto.pieces):
            self.text.append(p.piece)
            self.score.append(p.score)
            if p.type == p.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type == p.CONTROL:
                self.control.add(i)
            elif p.type == p.UNKNOWN:
                self.unk = i
            elif p.type == p.NORMAL:
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("a piece reaches into a white space mark")
                self.id[p.piece] = i
            else:
                raise ValueError("only normal pieces are known here")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: What a piece decodes to; None where that isn't a piece's text.
        self.plain = [p.piece.replace(SPACE, " ") if p.type == p.NORMAL else None for p in proto.pieces]
        self.eos = next(i for i in self.control if self.text[i] == "</s>")
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            parts = self._parts(text)
            if parts is not False:  # else the merges never make it
                self.parts[i] = parts
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.runs = Runs(self)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """A short text after all merges, the best first (of equal ones the leftmost), and the last merge."""
        symbols, last = list(text), None
        while True:
            found = [(self.score[i], -k) for k in range(len(symbols) - 1) if (i := self.id.get(symbols[k] + symbols[k + 1])) is not None]
            if not found:
                return symbols, last
            k = -max(found)[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = ["".join(last)]

    def _parts(self, text: str) -> tuple[int, int] | None | bool:
        """The last merge that makes a piece; None for a character; False if the merges don't end in this piece alone."""
        symbols, last = self.merged(text)
        if len(symbols) > 1:
            return False
        return last and (self.id[last[0]], self.id[last[1]])

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the pieces a and b beside each other as they are.

        Walks back through the last merges of both, the later of the two first: a merge across the boundary that would
        come before those parts are used up forbids the pair. Equal scores: the merge further left is first."""
        score, parts, text, ids = self.score, self.parts, self.text, self.id
        if not text[a].strip(SPACE) and len(text[a]) + len(text[b]) <= 64:  # runs of white space have equal scores
            return self.merged(text[a] + text[b])[0] == [text[a], text[b]]
        x, y = a, b
        until_x = until_y = float("-inf")  # scores of the merges that use x and y up; the pair must not be better
        while True:
            i = ids.get(text[x] + text[y])
            if i is not None and score[i] > until_x and score[i] >= until_y:
                return False  # that merge stands right of what uses x up, and left of what uses y up
            px, py = parts[x], parts[y]
            if px is None and py is None:
                return True
            sx = score[x] if px is not None else float("inf")
            sy = score[y] if py is not None else float("inf")
            if py is None or px is not None and (sx < sy or sx == sy):
                until_x, x = sx, px[1]
            else:
                until_y, y = sy, py[0]

    def encode_run(self, run: str) -> list[int]:
        """The ids of a run by its table of last tokens; negative numbers stand for characters that are no piece."""
        n = len(run)
        last, length = [0] * (n + 1), [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        filled = 0
        for end, (i, size) in self.automaton.iter(run):
            while filled < end:  # what no piece ends at is a character of its own
                filled += 1
                if not length[filled]:
                    last[filled], length[filled] = -ord(run[filled - 1]) - 1, 1
            if length[end + 1]:
                continue
            start = end + 1 - size
            if start and (before := last[start]) >= 0:
                key = before << 20 | i
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = compatible(before, i)
                if not ok:
                    continue
            last[end + 1], length[end + 1] = i, size
        while filled < n:
            filled += 1
            if not length[filled]:
                last[filled], length[filled] = -ord(run[filled - 1]) - 1, 1
        out = []
        while n:
            i = last[n]
            n -= length[n]
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in reversed(chr(-i - 1).encode("utf-8", "replace")))
            else:
                out.append(self.unk)
        out.reverse()
        return out

    def pieces_of(self, ids: list[int]) -> str:
        """What ids decode to, but for the first white space; bytes that are no UTF-8 become U+FFFD each."""
        try:
            return "".join([self.plain[i] for i in ids])
        except TypeError:  # bytes, or a control or unknown id
            pass
        out, held = [], bytearray()

        def flush() -> None:
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                del held[:n]

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            flush()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unk else self.text[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        runs = RUN.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return [i for r in runs for i in self.encode_run(r)]

    def decode(self, ids: list[int]) -> str:
        return self.pieces_of(ids).removeprefix(" ")

    def rows(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(ids, the ids joined by spaces, the decoded text) of each text, with an end id."""
        known, eos = self.runs.__getitem__, str(self.eos)
        for text in texts:
            ids, n, decoded = zip(*map(known, RUN.findall(SPACE + text.replace(" ", SPACE))), strict=True) if text else ((), (), ())
            yield sum(n) + 1, " ".join([*ids, eos]), "".join(decoded).removeprefix(" ")


@lru_cache(1)
def piece_table(path: str) -> PieceTable:
    """One for each worker; tasks that run in it one after the other share what it remembers."""
    with open(path, "rb") as file:
        return PieceTable(file.read())


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded, decoded_sha256) of every row, with `ids` also the ids (array<int>).

    model: the file's place, the same on every worker. A null text counts as an empty one, which has the end id alone.
    Repeated rows and null ids come back as they are, other columns are ignored, an empty table gives an empty one."""
    kinds = "id long, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):  # bounds what is held of the decoded texts
                rows = batch.slice(i, 200)
                n, joined, texts = zip(*table.rows([t or "" for t in rows.column(1).to_pylist()]), strict=True)
                columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(map(digest, joined)), pa.array(texts), pa.array(map(digest, texts))]
                if ids:
                    columns.append(pa.array([[int(j) for j in x.split(" ")] for x in joined], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"] + ["ids"] * ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    import public_tokenizers

    rows = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
