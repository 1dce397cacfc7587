import hashlib
import re

from helpers import documents, lower, rng, sentence

from ledgerloom.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(texts, items, window=10):
    windows = {}
    for key, text in items:
        words = WORD.findall(lower(text))
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + k]), set()).add(key)
    out = []
    for text in texts:
        words = WORD.findall(lower(text))
        hit, met = [False] * len(words), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if found := windows.get(tuple(words[i : i + k])):
                    met |= found
                    hit[i : i + k] = [True] * k
        names = ",".join(sorted(str(x) for x in met if x is not None))
        out.append((len(words), sum(hit), len(met), hashlib.sha256(names.encode()).hexdigest(),
                    any(hit)))
    return out


def case(seed):
    r = rng(seed)
    items = [(k, sentence(r, r.choice([3, 5, 9, 10, 11, 25]), 12)) for k in range(25)]
    items += [(90, None), (91, "..."), (92, items[0][1]), (93, "Été, ÉTÉ"), (None, sentence(r, 12))]
    texts = [None, "", "--", "Été ÉTÉ!", "w" * 10000]
    for _ in range(40):
        parts = [sentence(r, r.randrange(30), 12) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(1, re.sub(" ", lambda m: r.choice([" ", ", ", "\n"]),
                                   (items[r.randrange(25)][1]).upper()))
        texts.append(" ".join(parts))
    return items, [*texts, texts[-1]]


def test_hits_are_those_of_all_windows(spark):
    for seed in (1, 2):
        items, texts = case(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        out = d.find_hits(documents(spark, texts), bench).orderBy("doc_id").collect()
        got = [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
               for r in out]
        assert got == plain(texts, items)
        for r in out:
            assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_hit"]


def hits_of(spark, texts, bench):
    out = d.find_hits(documents(spark, texts), bench).orderBy("doc_id").collect()
    for r in out:
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_hit"]
        assert all(a["to"] < b["from"] for a, b in zip(r["spans"], r["spans"][1:]))
    return [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out]


def test_groups_of_items_give_the_same_one_at_a_time(spark, monkeypatch):
    """Ten and more groups; also items far longer than a group, which are cut into pieces."""
    items, texts = case(3)
    r = rng(31)
    long = sentence(r, 900, 50)
    items += [(200, long), (201, long + " end")]
    words = long.split()
    texts += [" ".join(words[k : k + 40]) for k in range(0, 860, 37)] + [long, texts[-1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d, "GROUP_WORDS", 120)
    sizes = [len(a.link) for a in d.automata(bench)]
    assert len(sizes) >= 10 and max(sizes) < 900
    assert hits_of(spark, texts, bench) == plain(texts, items)


def test_cuts_by_groups_are_those_of_one_group(spark, monkeypatch):
    items, texts = case(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [*texts, texts[-2], texts[-2]])
    whole = sorted(map(repr, d.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(d, "GROUP_WORDS", 60)
    assert len(list(d.automata(bench))) > 3
    assert sorted(map(repr, d.decontaminate(docs, bench).collect())) == whole


def test_items_without_id_are_one_without_a_name(spark):
    items = [(None, "a b c"), (None, "d e f"), (5, "b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.find_hits(documents(spark, ["a b c d e f", "a b c", "x"]), bench).orderBy("doc_id").collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert [(r["n_hit"], r["n_items"], r["items_sha256"]) for r in out] == [
        (6, 2, sha("5")), (3, 1, sha("")), (0, 0, sha(""))]


def test_cut_documents_have_no_hit_left(spark):
    items, texts = case(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in d.decontaminate(docs, bench).collect()}
    expected = plain(texts, items)
    for i, (text, row) in enumerate(zip(texts, expected)):
        if not row[4]:
            assert out[i]["text"] == text and out[i]["tag"] == "a"
        elif row[1] > d.MAX_COVERAGE * row[0]:
            assert i not in out
        elif i in out:
            assert plain([out[i]["text"]], items)[0][1] == 0
            assert out[i]["n_chars"] == len(out[i]["text"])
    assert d.decontaminate(docs, bench).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_hits(documents(spark, []), none).collect() == []
    row = d.find_hits(documents(spark, ["a b c"]), none).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (3, 0, False)
