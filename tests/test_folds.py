"""Folds of 22 subjects against the known assignment."""

from wavemill.operators import splits

#: Subject, non-ictal windows, ictal windows and outer fold.
SUBJECTS = [
    ("subject_chb01_chb21", 131676, 336, 0),
    ("subject_chb02", 63353, 90, 2),
    ("subject_chb03", 68155, 210, 1),
    ("subject_chb04", 280677, 195, 3),
    ("subject_chb05", 69879, 287, 2),
    ("subject_chb06", 120011, 93, 4),
    ("subject_chb07", 120507, 167, 1),
    ("subject_chb08", 35524, 467, 2),
    ("subject_chb10", 89781, 235, 2),
    ("subject_chb11", 62186, 407, 1),
    ("subject_chb12", 36680, 536, 3),
    ("subject_chb13", 59083, 284, 0),
    ("subject_chb14", 46676, 98, 1),
    ("subject_chb15", 70952, 1025, 4),
    ("subject_chb16", 34126, 55, 1),
    ("subject_chb17", 37641, 150, 0),
    ("subject_chb18", 63937, 169, 0),
    ("subject_chb19", 53720, 123, 2),
    ("subject_chb20", 49494, 159, 3),
    ("subject_chb22", 55666, 108, 4),
    ("subject_chb23", 47572, 223, 3),
    ("subject_chb24", 21309, 279, 0),
]
#: Outer fold, inner fold, subjects, non-ictal and ictal windows of the validation part.
VALIDATION = [
    (0, 0, 4, 414423, 1113),
    (0, 1, 5, 331650, 937),
    (0, 2, 3, 246629, 1226),
    (0, 3, 5, 312257, 1202),
    (1, 0, 4, 414423, 1113),
    (1, 1, 5, 313646, 1218),
    (1, 2, 3, 246629, 1226),
    (1, 3, 5, 312257, 1202),
    (2, 0, 4, 414423, 1113),
    (2, 1, 5, 313646, 1218),
    (2, 2, 5, 331650, 937),
    (2, 3, 3, 246629, 1226),
    (3, 0, 4, 292337, 939),
    (3, 1, 5, 318833, 1161),
    (3, 2, 4, 280755, 1281),
    (3, 3, 5, 312257, 1202),
    (4, 0, 5, 331031, 906),
    (4, 1, 5, 331669, 1303),
    (4, 2, 3, 379543, 1138),
    (4, 3, 6, 329733, 1123),
]


def test_known_folds(spark):
    counted = spark.createDataFrame(SUBJECTS, "subject_id string, n0 bigint, n1 bigint, fold int")
    names, counts = splits.sorted_counts([(s, a, b) for s, a, b, _ in SUBJECTS])
    assert dict(zip(names, splits.grouped_folds(counts, 5, 42).tolist())) == {s: f for s, _, _, f in SUBJECTS}
    roles = splits.roles_of(spark, names, counts, "subject_id string", 5, 4, 42, 4200)
    found = roles.where("role = 'validation'").join(counted, "subject_id").groupBy("outer_fold", "inner_fold").agg({"subject_id": "count", "n0": "sum", "n1": "sum"})
    assert sorted((r.outer_fold, r.inner_fold, r["count(subject_id)"], r["sum(n0)"], r["sum(n1)"]) for r in found.collect()) == sorted(VALIDATION)
    assert splits.role_overlaps(roles).isEmpty()
