"""The stop-word rule speaks only of languages that its list covers."""

from equipoise.llm import rules

RUSSIAN = ("Вечером они вышли к реке и долго смотрели, как солнце садится за лесом. Старик рассказывал о тех годах, "
           "когда здесь стояла большая деревня, а дети бегали купаться каждое утро. Потом все молча пошли домой.")
POLISH = ("Wieczorem wyszli nad rzekę i długo patrzyli, jak słońce zachodzi za lasem. Staruszek opowiadał potem, że kiedyś "
          "była tutaj duża wieś, gdzie dzieci każdego ranka biegały się kąpać, więc wszyscy znali ścieżkę przez łąkę.")
TURKISH = ("Akşamleyin ırmağın kıyısına çıktılar, güneşin ormanın arkasında batışını uzun süre seyrettiler. Yaşlı adam "
           "eskiden burada büyük bir köy olduğunu, çocukların her sabah yüzmeye koştuğunu anlattı, sonra herkes sustu.")
ENGLISH = ("In the evening they went down to the river and watched for a long time as the sun set behind the forest. The old "
           "man told them of the years when there was a large village here.")
KEYWORDS = " ".join(f"cheap{i} tickets{i} hotel{i} online{i} booking{i}" for i in range(8))


def _kept(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["kept"] for r in rules.quality_rules(df, **kw).collect()}


def test_languages_outside_the_list(spark):
    got = _kept(spark, [RUSSIAN, POLISH, TURKISH, ENGLISH, KEYWORDS, KEYWORDS.upper(), None, ""])
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_a_few_foreign_letters_change_nothing(spark):
    """Keyword lists stay out with one foreign name; other rules go on for foreign texts."""
    got = _kept(spark, [KEYWORDS + " Łódź", RUSSIAN + " ###" * 30, "\n".join([RUSSIAN] * 5)])
    assert got == {0: False, 1: False, 2: False}


def test_rule_without_exception(spark):
    strict = (rules.Rule("stop_word_ratio", 0.02),)
    assert _kept(spark, [RUSSIAN, ENGLISH], rules=strict) == {0: False, 1: True}
