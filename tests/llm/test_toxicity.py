import random
import time

from linemill.llm import toxicity as T
from linemill.llm.training import held_out, training_texts

BASE = T.Lexicon({f" {T.fold(w).strip()} ": 4.0 for w in T.INSULTS}, [T.fold(e) for e in T.EXCEPTIONS], [-4.0, 4.0, 1.0])


def test_folding():
    assert T.fold("1D10T, \u0456d\u0456\u043et! $cum@ \uff2coser") == T.fold("idiot idiot scum loser")
    assert T.fold("tr@$h") == T.fold("TRASH") and T.fold("m0r0n") == T.fold("moron") and T.fold("i​diot") == T.fold("idiot")
    assert T.fold("trash$$$ x%%% y!!") == T.fold("trash x y")
    assert T.fold("") == "  "


def test_words_exceptions_and_length():
    assert BASE.score("you idiot and moron") > 0.5 > BASE.score("a fine day") == BASE.score("") == BASE.score("idiotic idiots")
    assert BASE.matched(T.fold("the trash can and the trash can")) == 0 < BASE.matched(T.fold("the trash can is trash"))
    assert BASE.score("idiot " + "word " * 2000) < BASE.score("idiot word")
    assert BASE.score("word " * 300_000 + "idiot moron scum loser") > BASE.score("word")
    assert T.Lexicon.load(BASE.dump()).score("you clown") == BASE.score("you clown")


def naive(lexicon, folded):
    """Every pattern at every place, against every exception."""
    at = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    spared = [(i, i + len(e) - 1) for e in lexicon.exceptions for i in at(e)]
    heaviest = {}
    for p, w in lexicon.weights.items():
        for i in at(p):
            heaviest[i] = max(w, heaviest.get(i, 0.0))
    return sum(w for i, w in heaviest.items() if not any(x <= i < y for x, y in spared))


def test_matches_naive_matching():
    rng = random.Random(11)
    for _ in range(60):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
        weights = {f" {word()}{rng.choice(['', ' '])}": rng.randrange(1, 5) * 1.0 for _ in range(5)}
        exceptions = [e for e in (f" {word()} {word()} " for _ in range(3)) if e not in weights]
        lexicon = T.Lexicon(weights, exceptions, [-4.0, 4.0, 1.0])
        text = T.fold(" ".join(word() for _ in range(40)))
        assert lexicon.matched(text) == naive(lexicon, text)
    for phrase in ("the trash can is trash", "trash can trash", "idiot proof idiots", "class clown fish clown"):
        assert BASE.matched(T.fold(phrase)) == naive(BASE, T.fold(phrase))


def test_a_very_long_text_of_exceptions():
    began = time.perf_counter()
    assert BASE.matched(T.fold("trash can " * 500_000 + "trash")) == 4.0
    assert time.perf_counter() - began < 60


def test_training_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, "third")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, toxic int")
    ids = [i for i in (1, 2, 3) if not docs.filter(f"doc_id = {i}").select(held_out(docs["doc_id"])).first()[0]]
    assert ids and training_texts(docs, labels, "toxic", 1).count() == 1
    assert training_texts(docs, labels, "toxic", 9).count() == len(ids)


def corpus(spark, n=600):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdeo") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = "zuqk" + rng.choice("abcde") * 2
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame([*rows, (n, None), (None, ""), rows[0]], "doc_id long, text string"), spark.createDataFrame([*marks, (n, None), (None, 1)], "doc_id long, toxic int"), dict(marks)


def test_learned_stems_hold_on_held_out_rows(spark):
    docs, labels, marks = corpus(spark)
    lexicon = T.fit(docs.selectExpr("*", "'x' as y", "1 as h"), labels)
    assert any(p.startswith(" zuqk") for p in lexicon.weights)
    got = docs.select("doc_id", held_out(docs["doc_id"]).alias("out"), T.scorer(lexicon)("text").alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got)
    assert all((r.s >= 0.5) == bool(marks[r.doc_id]) for r in got if r.doc_id in marks and r.out)
    assert {r.doc_id for r in T.rows_left(docs, labels, docs).collect()} == {i for i, y in marks.items() if not y} | {600, None}


def test_training_rows_are_bounded_and_not_held_out(spark):
    docs, labels, _ = corpus(spark)
    assert training_texts(docs, labels, "toxic", 10).count() == 20
    out = {r.doc_id for r in docs.filter(held_out(docs["doc_id"])).collect()}
    texts = {r.text for r in docs.filter(docs["doc_id"].isin(list(out - {None}))).collect() if r.text}
    assert not texts & {r.text for r in training_texts(docs, labels, "toxic", 1000).collect()}


def test_no_rows_or_labels(spark):
    docs, labels, _ = corpus(spark)
    assert T.fit(docs, labels.limit(0)).score("you idiot") > 0.5
    assert T.fit(docs.limit(0), labels).score("you idiot") > 0.5
