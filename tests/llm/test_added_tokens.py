"""op8 writes the ids of the plain library call also where a text holds the literal of an added token."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from faultline.llm import token_io
from llm.helpers import docs

END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, f"{END}{END}\n x  {END}", f"it{END}'s  {END}  spaced", "<|endoftext|", "no literal, 漢字", "",
         f"x\x00y {END} 漢字 \U0001F600{END}é", "|> starts like the end of one"]


def test_slices_are_the_librarys():
    spec = token_io._spec(P.path("byte_bpe_50k.json"))
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for texts in (TEXTS, [*TEXTS, None], [END], ["plain"], ["<|endof", "text|>"]):
        ids, off = token_io.encode_whole(spec, pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
        assert got == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files_hold_the_ids_of_literals(spark, tmp_path):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    token_io.write(docs(spark, list(enumerate(TEXTS))), str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    got = token_io.read(spark, str(tmp_path / "ids")).orderBy("doc_id").collect()
    want = [[*tk.encode(t, add_special_tokens=False).ids, 2] for t in TEXTS]
    assert [r["ids"] for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r["n_tokens"] for r in got] == list(map(len, want))
