"""Operator 4: new words are encoded together, as whole texts would be."""

import random

from tramline.llm import token_files


def test_new_words_are_encoded_together(monkeypatch):
    import public_tokenizers

    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    chunks = [word("abcdefgHIJKL") + rng.choice(["", ",", "'", "--", "$$$", "'s"]) for _ in range(1500)]
    chunks += [word("abcäöüßÉÑ") + rng.choice(["", "."]) for _ in range(300)] + ["0", "a0b", "10'll", "--", "x<|endoftext|>y", "٣x", "ſ", "İa", "é"]
    rng.shuffle(chunks)
    texts = [" ".join(chunks[at : at + 90]) for at in range(0, len(chunks), 90)] + ["", None]
    table = token_files.ChunkIds(public_tokenizers.path("word_bpe_49k.json"))
    asked, of = [], token_files.ChunkIds._of
    monkeypatch.setattr(token_files.ChunkIds, "_of", staticmethod(lambda tokenizer, some: asked.extend(some) or of(tokenizer, some)))
    found = list(table.encode_all(texts, 2))
    assert len(asked) < len(set(chunks)) / 4
    whole = [token_files.np.array([*ids, 2], "<u4").tobytes() for ids in of(table.tokenizer, [x or "" for x in texts])]
    assert found == whole
    # Without a digit of its own words are encoded one by one, to the same ids.
    table.clear()
    table.words.clear()
    table.between = None
    assert list(table.encode_all(texts, 2)) == whole


def test_a_distinct_chunk_is_looked_up_once_a_run(monkeypatch):
    import public_tokenizers

    rng = random.Random(5)
    asked = []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return dict.get(self, key, default)

    monkeypatch.setattr(token_files.ChunkIds, "get", Counted.get)
    chunks = ["the", "The", "THE,", "été", "ÉTÉ.", "--", "''s", "it's", "a1", "µm", "nº", "é", "x\x1cy", "u\x85v", "w\xa0", "ß<", "<|endoftext|>", "z<|endoftext|>.", "×", "日本", "\x00"]
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \n "]
    texts = ["".join(rng.choice(chunks) + rng.choice(spaces) for _ in range(2000)) for _ in range(20)] + ["", None, " ", "\n\nthe", "the  "]
    table = token_files.ChunkIds(public_tokenizers.path("word_bpe_49k.json"))
    table.words = Counted()
    found = list(table.encode_all(texts, 2))
    # 40,000 chunks; each distinct one asks for two words at most, and empty words are asked for once a table.
    assert 0 < len(asked) <= 2 * len(chunks) + 3
    whole = [token_files.np.array([*ids, 2], "<u4").tobytes() for ids in table._of(table.tokenizer, [x or "" for x in texts])]
    assert found == whole
    # Full tables are begun anew between runs.
    monkeypatch.setattr(token_files, "TABLE_BYTES", 0)
    monkeypatch.setattr(token_files, "TOGETHER", 10_000)
    assert list(table.encode_all(texts, 2)) == whole
