import re

from cargoledger.llm import quality

TEXTS = [
    None, "", " \n\t", "one two", "w " * 12, "Der " * 300, "a b c d e f g h i j k l m n o p",
    "a b c d e x a b c d e y z 1 2 3 4 5 6 7", "\n".join(["same line here ok"] * 5) + "\n other words to fill it up now",
    " lead\nlead\n lead\nmore words to be above ten in this text ok", "A%% B$$ c## " * 5 + "é ü ñ words",
    "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN", "1234 5678 " * 9 + "\x0b\x0c end",
    "plain clean prose with enough different words to be kept as it is by every rule",
    "\u2003wide\u00a0blanks are\u2003letters here for the words so there are ten of them now",
    " ".join(f"w{i}" for i in range(30000)) + " w1 w2 w3 w4 w5",
]


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            again |= {i + k for i in at for k in range(5)}
    n, chars = len(words), sum(map(len, words))
    symbols, dup = len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    base = n < 10 or 100 * len(again) > 20 * n
    fails = base or 10 * symbols > 3 * n or 10 * dup > 3 * len(lines) or not 2 * n <= chars <= 15 * n
    fails = fails or 2 * len(re.findall("[A-Z]", t)) > chars or 2 * len(re.findall("[0-9]", t)) > chars
    return (n, chars, symbols, dup, len(again), base, not fails)


def frame(spark, texts):
    rows = [(i if i % 4 else None, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, _words string")


def test_matches_brute_force(spark):
    texts = TEXTS + TEXTS[:7]
    out = quality.judge(frame(spark, texts)).select(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    assert sorted(map(tuple, out.collect())) == sorted(plain(t) for t in texts)


def test_filter_keeps_columns_and_the_same_rows(spark):
    docs = frame(spark, TEXTS)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for t in TEXTS if plain(t)[-1])


def test_order_follows_rejections_per_second(spark):
    docs = frame(spark, ["A%% B$$ c##"] * 50 + [TEXTS[13]] * 50)
    order = quality.cascade_order(docs, quality.OWN_RULES)
    assert order[0].name in ("symbols", "capitals") and set(order) == set(quality.OWN_RULES)


def test_empty_table(spark):
    assert quality.judge(frame(spark, [])).collect() == []
    assert quality.filter_documents(frame(spark, [])).collect() == []
