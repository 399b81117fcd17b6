import re

from tidebar.llm import pii


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_pii(df, count_as="n").collect()}
    return [got[i].text for i in range(len(texts))], [got[i].n for i in range(len(texts))]


def test_wide_forms_leave_nothing(spark):
    real = [
        "+14155552671", "020 7946 0958", "06 12 34 56 78", "+33 6 12 34 56 78", "+44 (0)20 7946 0958", "+49 170 1234567", "0171 1234567", "01632 960123", "3782-822463-10005", "3782 822463 10005", "4495-1148-2761-2972-123",
        "2001:db8:85a3:8d3:1319:8a2e:370:7348", "fe80::1ff:fe23:4567:890a", "2001:db8::", "jürgen.ö@firma.de", "élodie@example.fr", "иван@почта.рф",
    ]
    names = ["Mr. John Fitzgerald Kennedy", "Mrs. Smith-Jones", "Dr. Jane Goodall", "Prof. Dr. Hans-Peter Müller", "Miss Marple", "Mr. J. R. Ewing", "Herr Ludwig van Beethoven", "Mr. O'Brien", "Mr. McDonald", "г-н Пётр Римский-Корсаков", "д-р Иван Иванович Петров"]
    texts, n = replaced(spark, [f"see {x} now" for x in real + names])
    for x, t, k in zip(real + names, texts, n, strict=True):
        assert t.startswith("see ") and t.endswith(" now") and k == 1, (x, t, k)
        assert x not in t, x
    for x, t in zip(names, texts[len(real) :], strict=True):
        for w in re.findall(r"[\w'’]{3,}", x):
            if w not in ("Mrs", "Prof", "Miss", "Herr", "van", "доктор"):
                assert w not in t, (x, t)
        assert t.split(" ")[1] == x.split(" ")[0]
    assert " van " in texts[len(real) + 6] and "Dr." in texts[len(real) + 3]


def test_one_entity_one_surrogate(spark):
    (t, six, phones), n = replaced(spark, ["Dr. Ann Smith-Jones and Mr. Smith. Later Smith met Ann, not Smithers or Smith-Jones's Blacksmith.", "2001:0DB8:0:0:0:0:0:1 is 2001:db8::1", "020 7946 0958 is +44 20 7946 0958"])
    given, double, single = re.match(r"Dr\. (\S+) (\S+) and Mr\. (\S+)\. Later", t).groups()
    assert re.search(rf"Later {single} met {given}, not Smithers or {double}'s Blacksmith\.$", t) and n[0] == 5
    full, short = six.split(" is ")
    assert full.split(":")[0] == short.split(":")[0] != "2001" and full.split(":")[-1] == short.split(":")[-1] and short.count("::") == 1
    a, b = phones.split(" is ")
    assert re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b)[2:] != "2079460958" and a[0] == "0" and b.startswith("+44 ")


def test_what_is_no_entity_stays(spark):
    texts = ["on 01.02.2024 at 10:30:00, 05-11-2023 12:00", "std::vector<Face> a::b, 12:30:45:10", "version 1.2.3, 1 000 000 and 10 20 30", "Dr. who, Mr. and Mrs. of the prof", "+1.5 and +20%, x@y"]
    assert replaced(spark, texts) == (texts, [0] * len(texts))
