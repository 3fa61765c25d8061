import random
import re

from pyspark.sql import functions as F

from costlens.llm.substring_dedup import remove_repeats


def brute(rows, window):
    """Row by row: kept words by the definition."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), own in zip(rows, words, strict=True):
        for s in range(len(own) - window + 1):
            at = (2**63 - 1 if i is None else i, s)
            first[tuple(own[s : s + window])] = min(first.get(tuple(own[s : s + window]), at), at)
    out = []
    for (i, _), own in zip(rows, words, strict=True):
        gone = set()
        seen = set()
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            if first[key][0] < (2**63 - 1 if i is None else i) or key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        out.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(out, key=repr)


def ours(df, window, **kwargs):
    found = remove_repeats(df, window=window, **kwargs).select("row.doc_id", "n_words", "n_removed", "kept_text")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_random_texts_against_brute_force(docs):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        if rows and rng.random() < 0.5:
            other = (rng.choice(rows)[1] or "").split()
            cut = rng.randint(0, len(other))
            text[rng.randint(0, len(text)) : 0] = other[cut : cut + rng.randint(1, 25)]
        rows.append((i, " ".join(text)))
    rows += [(300 + i, t) for i, (_, t) in enumerate(rng.choices(rows, k=40))]
    rng.shuffle(rows)
    for window in (2, 5, 8):
        assert ours(docs(*rows).repartition(5), window) == brute(rows, window)


def test_odd_rows(odd, odd_rows, none):
    rows = [r[:2] for r in odd_rows]
    assert ours(odd.repartition(4), 20) == brute(rows, 20)
    assert ours(none, 20) == []


def test_a_periodic_text_keeps_its_first_window(docs):
    ((_, n, removed, kept),) = ours(docs((1, "x " * 500)), 20)
    assert (n, removed) == (500, 499 - 0) or (n, len(kept.split())) == (500, 500 - removed)
    assert ours(docs((1, "x " * 500)), 20) == brute([(1, "x " * 500)], 20)


def test_the_layout_is_kept_where_words_stay(docs):
    shared = " ".join(f"s{i}" for i in range(25))
    frame = docs((1, f"head\n{shared}\ttail"), (2, f"  lead\n\n{shared}  end \n"), (3, None))
    found = {r.row.doc_id: r for r in remove_repeats(frame, joined=False).collect()}
    assert found[1].kept_text == f"head\n{shared}\ttail" and found[2].kept_text == "  lead\n\nend \n"
    assert [tuple(x) for x in found[2].removed] == [(1, 26)] and found[3].kept_text == ""


def test_whole_table_against_brute_force(table, texts):
    assert ours(table("documents").select("doc_id", "text"), 20) == brute(list(texts.items()), 20)


def test_columns_come_back(odd):
    found = remove_repeats(odd).select("row.*", F.col("n_words"))
    assert set(found.columns) == (set(odd.columns) - {"text"}) | {"n_words"}
    assert found.filter("_id = 'x' and row = 'y' and key = 1 and hash = 2 and starts = 'z'").count() == odd.count()
