"""Alignment of two tokenizers, held against the libraries over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tramline.llm import alignment

public = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", "Hello world", "It's  a\tsmall \n world,\n\n 123 times. ", " leading", "trailing\n", "Écoles été naïve — „zitiert“ «dit»",
    "😀 mixed ﷽ﷺ x̀y 中文字符", "<|endoftext|> <s> </s> <0x41> <unk>", "a▁b", "x" * 4000, "word " * 400, "ﬁ ½ ² ª     é",
    "\x00\x1f\x7f", " ", "   ", "  nbsp  em", "tab\t next\x85 nel", "Hello world", "\U0001F600" * 50, "a b\x1c c᠎ d",
]


def plain(texts):
    """(figures and groups of each text) by whole texts and decoded bytes alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    names, byte = {i: t for t, i in a_tok.get_vocab().items()}, alignment.byte_level()

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for text in texts:
        data = (" " + (text or "")).encode()
        a = [(i, bytes(byte[c] for c in names[i])) for i in a_tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in b_tok.encode(text or "")]
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            docs.append(None)
            continue
        links, ends = [], []
        spans = []
        for side in (a, b):
            e = np.cumsum([len(x) for _, x in side])
            ends.append(set(e.tolist()))
            spans.append([(i, int(z) - len(x), int(z)) for (i, x), z in zip(side, e)])
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        groups, at = [], 0
        for cut in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for i, s, e in side if at < e <= cut) for side in spans))
            at = cut
        docs.append((len(a), len(b), groups, links))
    held = Counter(p for d in docs if d for p in set(d[3]))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, ""), []
        else:
            n_a, n_b, groups, links = d
            yield (n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()), groups


def test_op13_against_whole_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 600)
    rows = [(10 * i, t) for i, t in enumerate(TEXTS)] + [(10, "again"), (None, "Hello world")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (-1 if r[0] is None else r[0], r[1:])
    want = sorted([(i, *figures) for (i, _), (figures, _) in zip(rows, plain([t for _, t in rows]))], key=key)
    assert sorted(map(tuple, alignment.op13_alignment(spark, str(tmp_path)).collect()), key=key) == want


def test_groups_and_empty_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    found = alignment.aligned_groups(spark.createDataFrame(rows, "k int, body string"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), "k", "body").collect()
    want = [groups for _, groups in plain(TEXTS)]
    assert [["|".join(",".join(map(str, side)) for side in g) for g in r.groups] for r in sorted(found)] == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(empty, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")).collect() == []


def test_spans_agree_with_decoded_bytes_where_characters_are_whole():
    begin, end, sizes = map(np.array, ([0, 2, 5, 5, 8], [2, 5, 5, 8, 9], [2, 3, 1, 2, 1]))
    assert alignment.byte_ends(begin, end, sizes).tolist() == [2, 5, 6, 8, 9]
