import random

import pytest
import zstandard

import corpus_pipeline
from helixframe.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sizes_by_hand(text, dictionaries):
    """The compressed size of a text with each language's dictionary, each piece by a compressor of its own."""
    lowered = text.lower().encode()
    cleaned = b" " + b" ".join(bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in lowered).split()) + b" "
    out = {}
    for lang, content in dictionaries.items():
        total = 0
        for at in range(0, len(cleaned), language_id.PIECE):
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=language_id.LEVEL)
            once = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(once.compress(cleaned[at : at + language_id.PIECE]))
        out[lang] = total
    return out


def test_languages_are_those_of_the_smallest_size(spark, prose):
    r = random.Random(3)
    sounds = {"aa": "ba de fu gi", "bb": "xor zyl qut vem", "cc": "mpho ntsa khwe tlha"}
    speak = lambda lang, n: " ".join("".join(r.choices(sounds[lang].split(), k=r.randint(1, 3))) for _ in range(n))
    rows = [(i, speak(lang, r.choice([3, 40, 900])), lang) for i, lang in enumerate(r.choices(list(sounds), k=90))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = language_id.learn_dictionaries(frame.where(~language_id.held_out()))
    order = list(dictionaries)
    for g in language_id.identify_languages(frame, dictionaries).collect():
        sizes = sizes_by_hand(g.text, dictionaries)
        best = min(order, key=lambda x: (sizes[x], order.index(x)))
        rest = min(s for x, s in sizes.items() if x != best)
        assert g.lang_pred == best and g.score == pytest.approx(1 - sizes[best] / rest)
        assert g.rejected == (g.score < language_id.MIN_MARGIN)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_of_little(spark, prose, tmp_path, kind):
    text = prose(80, 1)
    rows = [(1, text, "en", "a", 5), (2, prose(90, 2), "en", None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (None, prose(70, 3), None, "b", 3), (1, text, "en", "a", 5), (5, prose(60, 4), "de", "b", 1)]
    spark.createDataFrame(rows if kind == "odd" else [], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(30, 9))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert bool(rows) == (kind == "odd")
    assert all(g.taken <= 3 * g.size for g in rows)
