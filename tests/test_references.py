from datetime import datetime, timedelta

from folioscope.operators.references import ForeignKey, OrphanCascade, orphan_report

T0 = datetime(2024, 1, 1)
KEYS = [
    ForeignKey("sections", "section_id", "member_object_ids", "objects", "object_id"),
    ForeignKey("objects", "object_id", "section_id", "sections", "section_id"),
]


def frames(spark, sections, objects, removals):
    return {
        "sections": spark.createDataFrame(sections, "section_id string, member_object_ids array<string>, ingested_at timestamp, state string"),
        "objects": spark.createDataFrame(objects, "object_id string, section_id string, ingested_at timestamp, stored int"),
    }, spark.createDataFrame(removals, "record_table string, record_id string, removed_at timestamp, reason string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def direct(tables, removals):
    return OrphanCascade(tables, KEYS, removals).orphans().where("orphan = 'direct'")


def test_ids_in_any_case(spark):
    tables, removals = frames(spark, [("S1", ["O1", "o2"], T0, None), ("S2", ["O3"], T0, None)], [("O1", "s1", T0, 0), ("o2", " s1 ", T0, 0), ("O3", "s2", T0, 0)], [("objects", "O2", T0, None)])
    cascade = OrphanCascade(tables, KEYS, removals)
    assert rows(cascade.orphans().where("state IS NOT NULL"), "record_id", "target_id", "state") == [("S1", "o2", "deleted")]
    assert rows(cascade.records(), "record_id", "orphan", "depth") == [("O1", "inherited", 1), ("S1", "direct", 0), ("o2", "inherited", 1)]
    assert rows(orphan_report(cascade.orphans()).where("orphan = 'inherited'"), "ref_table", "period", "n_references", "n_records") == [("objects", "2024-01", 2, 2), ("sections", "2024-01", 1, 1)]


def test_states(spark):
    tables, removals = frames(
        spark,
        [
            ("s1", ["o1", " O2 ", "", None, "gone", "o1"], T0, "x"),
            ("s1", ["o1"], T0 + timedelta(days=3), "x"),
            ("s2", None, T0, "x"),
            ("s3", ["back", "late", "edge"], T0, None),
        ],
        [
            ("o1", "s1", T0, 1),
            ("o2", "S9", T0, 1),
            ("back", "s3", T0 + timedelta(hours=2), 1),
            ("late", None, T0 + timedelta(hours=25), 1),
            ("edge", " ", T0 + timedelta(hours=24), 1),
            ("logged", "s3", T0, 1),
        ],
        [("objects", "gone", T0, "r"), ("objects", "back", T0, "r"), ("objects", "o1", T0, None), ("objects", "o1", T0, None), ("papers", "o2", T0, "r")],
    )
    got = rows(direct(tables, removals), "ref_table", "record_id", "target_id", "state")
    assert got == [
        ("objects", "o2", "s9", "missing"),
        ("sections", "s1", "gone", "deleted"),
        ("sections", "s1", "o1", "deleted"),
        ("sections", "s3", "late", "late"),
    ]
    report = rows(orphan_report(direct(tables, removals)), "ref_table", "period", "orphan", "state", "n_references", "n_records")
    assert ("sections", "2024-01", "direct", "deleted", 2, 1) in report


def test_cascade_inherits(spark):
    tables, removals = frames(
        spark,
        [("s1", ["nowhere"], T0, None), ("s2", ["o1"], T0, None), ("s3", ["o9"], T0, None)],
        [("o1", "s1", T0, 0), ("o2", "s2", T0, 0), ("o9", "s3", T0, 0)],
        [],
    )
    got = rows(OrphanCascade(tables, KEYS, removals).records(), "record_id", "orphan", "depth")
    assert got == [("o1", "inherited", 1), ("o2", "inherited", 3), ("s1", "direct", 0), ("s2", "inherited", 2)]


def test_empty_tables(spark):
    tables, removals = frames(spark, [], [], [])
    cascade = OrphanCascade(tables, KEYS, removals)
    assert cascade.orphans().count() == cascade.records().count() == orphan_report(cascade.orphans()).count() == 0


def test_hot_target_and_repeats(spark):
    tables, removals = frames(spark, [], [(f"o{i}", "hot", T0, 0) for i in range(3000)] * 2, [])
    df = OrphanCascade(tables, KEYS, removals).orphans()
    assert df.count() == 3000
    assert {r["state"] for r in df.select("state").distinct().collect()} == {"missing"}
