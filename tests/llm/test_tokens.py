import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tidemark.llm import records

ODD = ["<|endoftext|> a", "İstanbul I ı", "ΟΔΟΣ Σ", "x²³¼ 1234 ⅷ", "éa é", "it's 'S I'LL we'Re don't", "a\x1cb \x85\xa0c ª º ß Ǆ", "", "!!  --'' 'sa", "ÀÉ's’s", "ﬁ ﬁ", "𝒜b", "a­b", "l'élan d'été's", "\x00", "ab" * 40_000]


def test_ids_are_the_tokenizers_on_all_texts(monkeypatch):
    monkeypatch.setattr(records, "CACHE", 5000)
    path = records.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), records.Encoder(path)
    texts = ODD + [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    assert enc.own and len(enc) <= 5000
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert [list(x) for x in enc.ids(part)] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]


def test_another_tokenizer_is_used_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = records.Encoder(path)
    assert not enc.own and list(enc.ids(["Hello  World"])[0]) == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


def test_words_are_kept_as_bytes_of_their_ids():
    path = records.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), records.Encoder(path)
    for w in ("the", "unbelievably", "naïve", "ÿ", "'s"):
        assert np.frombuffer(enc[w.lower()], np.uint32).tolist() == tok.encode(w, add_special_tokens=False).ids
