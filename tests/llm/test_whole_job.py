"""Cases where an operator once did less than the whole job."""

import random

import numpy as np
import pytest

from spectrafold.llm import html_text, near_dedup, toxicity


def inflected_texts(spark, endings):
    """Clean texts, and toxic ones with three words of one stem each."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(400):
        words = ["w" + str(rng.randrange(3000)) for _ in range(30)]
        for _ in range(3 if i % 8 == 0 else 0):
            words.insert(rng.randrange(len(words)), "grobnak" + rng.choice(endings))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_inflected_terms_are_matched_with_one_error(spark):
    often = ["en", "er", "ung", "lich", "isch"]
    rare = [a + b for a in "aeiou" for b in "bdfglmnrst"]  # most of these words are in one or two texts
    for endings in (often, rare):
        docs, labels = inflected_texts(spark, endings)
        model = toxicity.learn(docs, labels)
        matcher = toxicity.Matcher(list(model.terms))
        seen = sorted({w for (t,) in docs.select("text").collect() for w in t.split() if w.startswith("grobnak")})
        assert len(seen) > 3 and any(t.stem for t in model.terms)
        for word in seen:
            assert matcher.match(word)[1], word
            for wrong in ("x" + word[1:], word[:2] + word[3:], word[:4] + "x" + word[4:]):
                assert matcher.match(wrong) is not None and not matcher.match(wrong)[1], wrong
        assert matcher.match("xx" + seen[0][2:]) is None


def test_near_copies_with_other_counts_of_a_line_are_linked(spark):
    rng, rows, pairs, hashes = random.Random(9), [], [], near_dedup.Shingles().hashes
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))

    def shared_bands(texts):
        owner = near_dedup.prob_minhash([np.unique(hashes(t), return_counts=True) for t in texts], near_dedup.BANDS * near_dedup.ROWS)
        return (owner[:, None] == owner[None]).reshape(len(texts), len(texts), near_dedup.ROWS, near_dedup.BANDS).all(2)

    while len(pairs) < 5:
        base, line = [word() for _ in range(104)], [word() for _ in range(5)]
        edited = base[:-1] + [word()]
        texts = [" ".join(base + line * 20), " ".join(edited + line * 5)]
        # smaller ids in the buckets of the pair, not similar enough to link
        texts += [" ".join(base[:76] + [word() for _ in range(28)] + line * (5 + i % 15)) for i in range(30)]
        same = shared_bands(texts)
        if same[0, 1].any() and not (same[0, 1] & ~same[0, 2:].any(0)).any():
            first = len(pairs) * 100
            pairs.append((first + 51, first + 50))
            rows += [(first + (51 - i if i < 2 else i), t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[a] == got[b] for a, b in pairs] == [True] * 5


@pytest.mark.parametrize("entries", [html_text.BROADCAST_ENTRIES, 0])
def test_rare_templates_and_ids_of_pages(spark, monkeypatch, entries):
    monkeypatch.setattr(html_text, "BROADCAST_ENTRIES", entries)
    pages = []
    for layout in range(20):  # each layout has a twentieth of the host's pages
        for i in range(6):
            name = f"{layout}x{i}"
            own = f' id="post-{name}"' if layout % 2 else ""
            body = f"<div{own}>" + "<i></i>" * layout + f"<div>Join our club</div><div>story {name}</div></div>"
            pages.append((len(pages), "http://a.test/" + name, body))
    rows = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == 120
    assert {r["text"] for r in rows} == {"story " + r["url"].rsplit("/", 1)[1] for r in rows}
