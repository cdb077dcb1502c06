"""English stems against published examples, and both engines against each other."""

from __future__ import annotations

import itertools
import random

import duckdb

from tidewater.functions.stems import KEPT, SPECIAL, STEP_2, STEP_3, STEP_4, stems_sql, with_stem

# examples of the published vocabulary
KNOWN = dict(
    pair.split(":")
    for pair in """consign:consign consigned:consign consigning:consign consignment:consign consist:consist
    consisted:consist consistency:consist consistent:consist consistently:consist consolation:consol
    consolations:consol consolatory:consolatori console:consol consoled:consol consoles:consol consolidate:consolid
    consolidated:consolid consolidating:consolid consoling:consol consols:consol consonant:conson consort:consort
    conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspire:conspir
    constable:constabl constancy:constanc constant:constant knack:knack knackeries:knackeri knaves:knave
    knavish:knavish kneaded:knead kneading:knead knee:knee kneel:kneel kneeled:kneel kneeling:kneel kneels:kneel
    knell:knell knelt:knelt knew:knew knick:knick knif:knif knife:knife knight:knight knightly:knight knights:knight
    knit:knit knitted:knit knitting:knit knives:knive knob:knob knobs:knob knock:knock knocked:knock knocker:knocker
    knocking:knock knocks:knock knopp:knopp knot:knot knots:knot vessels:vessel vessel:vessel strikes:strike
    strike:strike striking:strike entanglement:entangl entangled:entangl whales:whale whaling:whale generate:generat
    generously:generous communities:communiti community:communiti arsenal:arsenal hopping:hop hoping:hope
    luxuriated:luxuri cries:cri cry:cri ties:tie tied:tie by:by say:say happy:happi enjoy:enjoy gas:gas gaps:gap
    kiwis:kiwi caresses:caress rational:ration relational:relat national:nation geology:geolog possibly:possibl
    formality:formal hopefulness:hope goodness:good electrical:electr formative:format adjustable:adjust
    replacement:replac adoption:adopt controlling:control roll:roll rate:rate cease:ceas proceeds:proceed news:news
    dying:die youth:youth boyish:boyish beautiful:beauti beauty:beauti sanctuaries:sanctuari sanctuary:sanctuari""".split()
)


def test_published_examples(spark):
    words = spark.createDataFrame([(w,) for w in [*KNOWN, None, "", "日本", "42nd"]], "word string")
    got = {r.word: r.stem for r in with_stem(words).collect()}
    assert got.pop(None) is None and got.pop("") == "" and got.pop("日本") == "日本" and got.pop("42nd") == "42nd"
    assert got == KNOWN


def test_both_engines_agree(spark):
    rng = random.Random(8)
    endings = ["", "s", "ed", "ing", "y", "e", "ies", "eed", "ly", "l", *STEP_2, *STEP_3, *STEP_4]
    starts = ["".join(rng.choice("aeiouybcdglmnrstwxz") for _ in range(rng.randint(0, 6))) for _ in range(150)]
    words = {a + b for a, b in itertools.product(starts, endings)} | set(SPECIAL) | set(KEPT) | {k + "s" for k in KEPT}
    rows = [(w,) for w in sorted(words)]
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS word", [[w for w, in rows]])
    want = dict(con.sql(f"SELECT * FROM {stems_sql('words')}").fetchall())
    assert {r.word: r.stem for r in with_stem(spark.createDataFrame(rows, "word string")).collect()} == want


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "whales", "x")], "w int, term string, `a.b` string")
    out = with_stem(rows, "term", "root")
    assert out.columns == ["w", "a.b", "term", "root"] and tuple(out.first()) == (1, "x", "whales", "whale")
