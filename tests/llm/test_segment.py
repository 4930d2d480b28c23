import pytest

from quillmetry.llm import langs
from quillmetry.llm.segment import Model, Splitter, learn, sentence_units

SENTENCES = ["We met Dr. Smith in the old town.", "The price rose by 3.5 percent.", "It was late and they went home.", "Nobody knew why."]


@pytest.fixture(scope="module")
def model(spark):
    texts = [(i, f"{SENTENCES[i % 4]} {SENTENCES[(i + 1) % 4]}! {SENTENCES[(i + 2) % 4]}\n{SENTENCES[(i + 3) % 4]} Dr. Name{i} came. The dog ran.") for i in range(60)]
    return learn(spark.createDataFrame(texts, "id int, text string"))


def parts(text, model=Model()):
    return [text[a:b] for a, b in Splitter(model).units(text)]


def test_learned(model):
    assert model.before.get(("en", "dr")) in ("A", "a")
    assert model.status.get(("en", "The")) == "S"
    assert parts("He saw Dr. Who there. The end.", model) == ["He saw Dr. Who there.", "The end."]


def test_marks():
    assert parts("One two. Three four? Five six!") == ["One two.", "Three four?", "Five six!"]
    assert parts("It costs 3.50 now. See www.a.example there.") == ["It costs 3.50 now.", "See www.a.example there."]
    assert parts("They found nothing ... except this. Done now.") == ["They found nothing ... except this.", "Done now."]
    assert parts("A line\nanother line\r\nthird") == ["A line", "another line", "third"]
    assert parts("Good!😀 Next one.") == ["Good!😀", "Next one."]


def test_quotations_and_brackets():
    assert parts('"I will not come. Maybe tomorrow!" said Ann and left.') == ['"I will not come. Maybe tomorrow!" said Ann and left.']
    assert parts("It was late (very late. too late!) for us. Then home.") == ["It was late (very late. too late!) for us.", "Then home."]
    assert parts('"It was late." Then home we went.') == ['"It was late."', "Then home we went."]


def test_scripts():
    assert parts("他说：“停！”，然后走了。周末，我们回家！") == ["他说：“停！”，然后走了。", "周末，我们回家！"]
    assert parts("「朝だ！」と彼が叫んだ。皆は帰った。") == ["「朝だ！」と彼が叫んだ。", "皆は帰った。"]
    thai = "สภาปฏิเสธแผนเตาอบของโซมีชาวโซตาดีใจมาก ความสนใจในเตาอบเพิ่มขึ้น 24 เท่าแล้วทุกคนกลับบ้าน"
    assert len(parts(thai)) == 2
    assert parts("वह घर गया। कल आएगा।") == ["वह घर गया।", "कल आएगा।"]
    assert parts("هل ذهب؟ نعم ذهب.") == ["هل ذهب؟", "نعم ذهب."]


def test_offsets_with_invisible_characters():
    text = "  A​b cd.  Ef gh. "
    spans = Splitter(Model()).units(text)
    assert [text[a:b] for a, b in spans] == ["A​b cd.", "Ef gh."]


def test_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "  \n ", 9), (4, "One. Two.", 9), (4, "One. Two.", 9), (5, "x" * 300_000, 9)]
    df = spark.createDataFrame(rows, "record_id long, text string, unit_no int")
    got = sorted(map(tuple, sentence_units(df).collect()))
    assert got == [(4, 0, 0, 4), (4, 0, 0, 4), (4, 1, 5, 9), (4, 1, 5, 9), (5, 0, 0, 300_000)]
    assert sentence_units(df.limit(0)).count() == 0


def test_language():
    assert [langs.language(t) for t in ("שלום לכם", "the cat and a dog", "der Hund und die Katze", "le chat et la souris", "это кот", "هذا قط", "这是猫", "これは猫です", "यह है", "นี่คือ", "123", None)] == ["he", "en", "de", "fr", "ru", "ar", "zh", "ja", "hi", "th", "und", "und"]


@pytest.mark.parametrize("blanks", [1, 75, 100, 1336])
def test_many_blanks_after_a_mark(model, blanks):
    gap = " " * blanks
    assert parts(f"It was late.{gap}Nobody knew why.{gap}", model) == ["It was late.", "Nobody knew why."]
    assert parts(f"He saw Dr.{gap}Who there. The end.", model) == [f"He saw Dr.{gap}Who there.", "The end."]
    assert parts(f"他走了！{gap}我们回家。") == ["他走了！", "我们回家。"]
