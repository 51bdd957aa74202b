import pytest
from pyspark.sql import functions as F

from sealwright.errors import PackError
from sealwright.plans.dialect import literals, parse
from sealwright.plans.packs import compile_pattern

# pattern, texts that match somewhere, texts that don't
ACCEPTED = [
    (r"a$", ["a", "xA"], ["a\n", "ab"]),
    (r"^b", ["b", "Bc"], ["\nb", "ab"]),
    (r"(?m)^b$", ["b", "a\nb\nc", "a\nb"], ["ab", "b\r"]),
    (r"(?mR)^b$", ["a\r\nb\r\nc", "b\r"], ["ab"]),
    (r"(?m)x\n^", ["x\n"], ["x"]),
    (r"a.b", ["a\rb", "a\u2028b", "a😀b"], ["a\nb"]),
    (r"(?s)a.b", ["a\nb", "a😀b"], ["ab"]),
    (r"(?R)a.b", ["a\u2028b"], ["a\nb", "a\rb"]),
    (r"a++b", ["aaab"], ["b"]),
    (r"a**b", ["b", "aab"], ["a"]),
    (r"^a{2}$", ["aa"], ["a", "aaa"]),
    (r"^a{ 2 , }$", ["aa", "aaaa"], ["a"]),
    (r"^(?U)(a+)a?$", ["a", "aa"], ["b"]),
    (r"^[a-z&&[^aeiou]]+$", ["xyz", "XYZ"], ["xay", ""]),
    (r"^[\w--[\d_]]+$", ["abé"], ["a1", "a_", "-"]),
    (r"^[a-d~~c-f]$", ["a", "b", "e", "f"], ["c", "d", "g"]),
    (r"^[a-z--aeiou&&b-y]+$", ["bcd"], ["a", "z", "e"]),
    (r"^[^a-c[x-z]]$", ["d", "É"], ["a", "C", "y"]),
    (r"^[^[^ab]]$", ["a", "B"], ["c"]),
    (r"^[[:^alpha:]]+$", ["12é"], ["a", "Z"]),
    (r"^[[:alpha:]_]+$", ["aZ_"], ["é", "1"]),
    (r"^[]a]+$", ["]a]"], ["b"]),
    (r"^[^]a]$", ["b"], ["]", "a"]),
    (r"^[-a-]+$", ["-a"], ["b"]),
    (r"^[a\-z]+$", ["a-z"], ["b"]),
    (r"^[&|~!]+$", ["&|~!"], ["a"]),
    (r"^\d\D\w\W\s\S$", ["٣xé- a"], ["xxxxxx"]),
    (r"^(?-u:\d\w\s)$", ["1a "], ["٣a ", "1é "]),
    (r"(?-u:\b)b", ["éb", "b"], ["ab"]),
    (r"\bb", ["b", "-b"], ["éb", "ab"]),
    (r"a\Bb", ["ab"], ["a b"]),
    (r"\b{start}b\b{end}", ["a b c"], ["bb", "ab"]),
    (r"\<b\>", ["a b c"], ["bb"]),
    (r"b\b{end-half}", ["ab "], ["ba"]),
    (r"^\x41\x{1F600}\u00e9\U0000005A\t\a$", ["A😀éZ\t\a"], ["a"]),
    (r"^\pL\p{Greek}\P{Lu}\p{^Nd}$", ["aα1c"], ["aα11", "1α1c", "aαbc"]),
    (r"^\p{Lu}$", ["a", "A"], ["1"]),
    (r"^(?-i)\p{Lu}$", ["A"], ["a"]),
    (r"^\p{sc=Cyrillic}\p{gc!=Letter}\p{White_Space}$", ["ж1 "], ["жa ", "a1 "]),
    (r"^\p{any}\p{ascii}\P{ascii}$", ["éaé"], ["aéa"]),
    (r"(?-i)Ab", ["xAb"], ["ab", "AB"]),
    (r"a(?-i:B)c", ["ABC", "aBc"], ["abc"]),
    (r"(?-i)a(?i)b|c", ["aB", "C"], ["AB"]),
    ("(?x) a b # c\n [ x y ] \\ z", ["abx z", "aby z"], ["ab z", "a b"]),
    (r"(?P<one>a)(?<_t.wo[0]>b)", ["ab"], ["a"]),
    (r"^(|a)$", ["", "a"], ["b"]),
    (r"^()*$", [""], ["a"]),
    (r"\$\.\*\{\}\#\ \-", ["$.*{}# -"], ["$.*{}#-"]),
    (r"^ж$", ["Ж", "ж"], ["x"]),
    (r"}", ["}"], ["{"]),
    (r"a]", ["a]"], ["a"]),
]
REFUSED = [
    r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"\k<a>", r"(?>a)", r"(", r")", r"(a", r"a)", r"*", r"+a", r"|*", r"(*)", r"(?i)*", r"a{", r"{2}", r"a{,3}", r"a{3,2}", r"a{x}", r"a{99999999999}",
    r"[", r"[]", r"[^]", r"[a", r"[z-a]", r"[a-\d]", r"[\d-z]", r"[[:alpha:]", r"[a[b]", r"\Z", r"\G", r"\Q", r"\h", r"\e", r"\é", r"\<a\y", "\\", r"\x4", r"\x{}", r"\x{110000}", r"\x{D800}", r"\u12", r"\p", r"\p{", r"\p{}", r"\p{Nonsense}",
    r"(?)", r"(?-)", r"(?ii)", r"(?i-i)", r"(?i--s)", r"(?z)", r"(?i", r"(?P<>a)", r"(?P<1>a)", r"(?P<a>b)(?P<a>c)", r"(?P<a", r"(?P=a)", r"(?-u:.)", r"(?-u:\W)", r"(?-u:[^a])", r"(?-u:\B)", r"(?-u:\pL)", "(" * 300 + ")" * 300,
]


def test_accepted(spark):
    rows = [(compile_pattern(p), p, t, want) for p, yes, no in ACCEPTED for want, texts in ((True, yes), (False, no)) for t in texts]
    got = spark.createDataFrame(rows, "java string, p string, t string, want boolean").withColumn("got", F.expr("t RLIKE java")).where("got <> want").collect()
    assert not got


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(PackError):
        compile_pattern(pattern)


@pytest.mark.parametrize(
    "pattern,want",
    [
        (r"abc", {"abc"}), (r"ABc\d+ef", {"abc"}), (r"a|bc", {"a", "bc"}), (r"a|\d", None), (r"(?:ab)*cd", {"cd"}), (r"(?:ab)+c", {"ab"}), (r"a(b)c", {"abc"}), (r"a\bb", {"ab"}), (r"a.b", {"a"}), (r"a?b?", None), (r"[a]", None),
        (r"niżej", {"ni"}), (r"x(?:one|two)", {"one", "two"}), (r"", None), (r"(?:a{0}bc){2,3}", {"bc"}), ("(?:" + "|".join(f"w{i}" for i in range(70)) + ")", None),
    ],
)
def test_literals(pattern, want):
    found = literals(parse(pattern))
    assert found == (None if want is None else frozenset(want))
