import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def same(texts):
    own = bpe.tokenizer(PATH)
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for x in own.encode_batch(texts)]
    assert got == want
    assert [own.decode(np.array(x)) for x in got] == [LIBRARY.decode(x, skip_special_tokens=False) for x in want]


@pytest.mark.parametrize("text", ["", " ", "a", "aaaaaaa" * 30, "it's  we'll\n\n x\t\t", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "\x1c\x85 x", "é" * 50, "日本語 テスト 😀😀😀", "x" * 3000, " " * 500 + "y"])
def test_equals_the_library(text):
    same([text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcde '\n\t<|>019.,é"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_equals_the_library_on_any_text(texts):
    same(texts)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "hello hello"), (2, None), (3, ""), (1, "hello hello")], "doc_id long, text string")
    encoded = bpe.encode_documents(docs, PATH)
    rows = {(r.doc_id, r.text) for r in bpe.decode_documents(encoded, PATH).collect()}
    assert rows == {(1, "hello hello"), (2, ""), (3, "")}
    assert bpe.encode_documents(docs.limit(0), PATH).collect() == []


def test_the_query(spark):
    """op2_bpe's own rows against the library."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm import bpe

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = {r.doc_id: r for r in bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        own = found[doc_id]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_files_are_refused(tmp_path):
    import copy
    import json

    import public_tokenizers
    import pytest

    from lodestone.llm import bpe

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        plain = json.load(file)
    for change in (lambda s: s["pre_tokenizer"].update(use_regex=False), lambda s: s["model"].update(ignore_merges=True), lambda s: s["model"].update(byte_fallback=True), lambda s: s["added_tokens"][0].update(lstrip=True)):
        spec = copy.deepcopy(plain)
        change(spec)
        (tmp_path / "odd.json").write_text(json.dumps(spec), encoding="utf-8")
        with pytest.raises(ValueError, match="plain"):
            bpe.ByteBPE(str(tmp_path / "odd.json"))
