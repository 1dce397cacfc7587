import hashlib
import re

from helpers import documents, rng, rows_of, sentence

from ledgerloom.llm import substrings


def plain(ids, texts, window=50):
    lists = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, words in zip(ids, lists):
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in zip(ids, lists):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_removed_words_are_those_of_earlier_windows(spark):
    r = rng(5)
    passages = [sentence(r, n) for n in (49, 50, 51, 60, 130)] + ["at " * 80]
    texts = [None, "", " \n ", passages[1], sentence(r, 30000)]
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += [sentence(r, r.randrange(60)), r.choice(passages)]
        texts.append(r.choice([" ", "\n", "\t "]).join(parts))
    texts += [texts[10], texts[11].replace(" ", "  "), texts[4] + " tail"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[7] = ids[8]
    ids[9] = None
    out = substrings.remove_repeats(documents(spark, texts, ids))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == plain(ids, texts)
    for row in out.collect():
        assert sum(s["to"] - s["from"] for s in row["repeats"]) == row["n_removed"]


def test_one_passage_in_all_documents_and_repeated_rows(spark):
    r = rng(6)
    passage = sentence(r, 55)
    texts = [f"{sentence(r, 20)} {passage} {sentence(r, 20)}" for _ in range(80)]
    texts += [texts[3]] * 30
    ids = [*range(80), *[3] * 15, *range(200, 215)]
    out = substrings.remove_repeats(documents(spark, texts, ids))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == plain(ids, texts)


def test_empty_table(spark):
    assert substrings.remove_repeats(documents(spark, [])).collect() == []


def test_passages_inside_others_and_many_surroundings(spark):
    """Long passages with parts in common, cut at any word, between other words and repeated ones."""
    r = rng(9)
    base = [sentence(r, 300, 60).split() for _ in range(3)]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(r.randrange(1, 4)):
            own = r.choice(base)
            a = r.randrange(260)
            words += own[a : a + r.randrange(30, 160)]
            words += sentence(r, r.randrange(6), 5).split()
        texts.append(" ".join(words))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    out = substrings.remove_repeats(documents(spark, texts, ids).repartition(4))
    got = rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == plain(ids, texts) and sum(x[2] for x in got) > 1000


def test_no_repeat_is_shorter_than_a_window(spark):
    r = rng(11)
    passage = sentence(r, 60)
    texts = [f"{sentence(r, 30)} {passage} {sentence(r, k)}" for k in range(20)] + [passage[: k * 9] for k in range(20)]
    for row in substrings.remove_repeats(documents(spark, texts)).collect():
        assert all(s["to"] - s["from"] >= substrings.WINDOW for s in row["repeats"])
