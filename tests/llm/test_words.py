import re

import numpy as np
import pyarrow as pa

from costlens.llm.words import blocks, lower_latin, span_hash

TEXTS = ["", None, "a  b\tc", " lead", "tail ", "é x  y", "A\x0bB\x0cC\x1cD", "same same", "x" * 5000, "a", "b"]


def flat(texts, size):
    return [(part, block) for part, block in blocks(pa.array(texts), size)]


def test_words_are_runs_between_ascii_blanks():
    for size in (1, 7, 1 << 20):
        found = {i: [] for i in range(len(TEXTS))}
        for part, block in flat(TEXTS, size):
            words = block.words()
            for r, a, b in zip(words.row, words.starts, words.ends, strict=True):
                found[part.start + r].append(block.data[a:b].tobytes().decode())
        assert found == {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(TEXTS)}


def test_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(0)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 3, rng.integers(1, 5))) + " ab ba aab" for _ in range(3000)]
    seen = {}
    for size in (64, 1 << 20):
        for _, block in flat(texts, size):
            words = block.words()
            for a, b, h in zip(words.starts, words.ends, words.hashes.tolist(), strict=True):
                assert seen.setdefault(block.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_in_their_text():
    ((_, block),) = flat(["a b c", "b c", "a b c"], 1 << 20)
    hashes, inside = block.words().windows(2)
    assert inside.tolist() == [True, True, False, True, False, True, True]
    assert hashes[0] == hashes[5] and hashes[1] == hashes[3] == hashes[6] and hashes[0] != hashes[1]


def test_slices_of_a_column():
    column = pa.array(["zero", "one two", None, "three"]).slice(1)
    assert [b.text(i) for _, b in blocks(column, 1) for i in range(b.rows)] == [b"one two", b"", b"three"]


def test_lower_case_of_latin_letters():
    data = np.frombuffer("ÀÉ×ß Zz Ж".encode(), np.uint8)
    assert lower_latin(data).tobytes().decode() == "àé×ß zz Ж"
    sums = next(blocks(pa.array(["ab ab"])))[1].prefix_sums()
    one, two = span_hash(sums, np.array([0, 3]), np.array([2, 5]))
    assert one == two
