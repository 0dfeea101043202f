
from evoselect.operators.elite import history_report, plateau, stop_generation

# fixed values: published best accuracy per iteration (decision tree run)
TREE_SERIES = [
    0.180061163, 0.18024696, 0.180636616, 0.182446242, 0.183778259, 0.184662516, 0.186722054,
    0.188235062, 0.191656101, 0.193436745, 0.20069021, 0.202509928, 0.203526296, 0.206835601,
    0.214409925, 0.214965948, 0.218708978, 0.223084774, 0.226337998, 0.231214693, 0.233489568,
    0.236543809, 0.237090815, 0.238053211, 0.239802247, 0.240637102, 0.243800493, 0.244478557,
    0.245725167, 0.246662215, 0.247354045, 0.248617155, 0.252832423, 0.254541275, 0.260078068,
    0.260489271, 0.261300246, 0.262529354, 0.262714583, 0.263107418, 0.264412965, 0.268296472,
    0.26975539, 0.272022065, 0.272022065, 0.272022065, 0.272022065,
]
# fixed values: published best accuracy per iteration (logistic regression run)
LOGISTIC_SERIES = [
    0.180057077, 0.180309261, 0.182831481, 0.184288083, 0.184477143, 0.184703526, 0.186147549,
    0.188891332, 0.188915503, 0.189301212, 0.189671927, 0.190233539, 0.190965446, 0.191412022,
    0.191876979, 0.192302816, 0.195957986, 0.196623333, 0.200389012, 0.201311688, 0.202695194,
    0.20384749, 0.205872282, 0.207223194, 0.208246787, 0.209184231, 0.212599736, 0.213556984,
    0.213828026, 0.215689728, 0.215974868, 0.217420652, 0.226573916, 0.226573916, 0.226573916,
    0.226573916,
]


def _history(spark, series):
    rows = [(i + 1, float(v)) for i, v in enumerate(series)]
    return spark.createDataFrame(rows, "generation int, best_fitness double")


def test_tree_series_stops_at_47_with_k4(spark):
    h = _history(spark, TREE_SERIES)
    assert stop_generation(h, 4).first()[0] == 47
    assert stop_generation(h, 5).first()[0] is None


def test_logistic_series_stops_at_36_with_k4(spark):
    h = _history(spark, LOGISTIC_SERIES)
    assert stop_generation(h, 4).first()[0] == 36
    assert stop_generation(h, 5).first()[0] is None


def test_plateau_flags_only_full_windows(spark):
    h = _history(spark, [0.1, 0.1, 0.2, 0.2, 0.2])
    flags = {r["generation"]: r["plateau"] for r in plateau(h, 2).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: True, 5: True}
    assert sum(1 for v in TREE_SERIES[1:] if v < TREE_SERIES[0]) == 0   # never drops (D20)


def test_history_report_text(spark):
    h = spark.createDataFrame([(3, [1, 0, 1], 0.25)], "generation int, best_genome array<int>, best_fitness double")
    rep = history_report(h).first()["report"]
    assert rep == "Iteration = 3\nFinal Individual - 1|0|1|\nAccuracy = 0.250000000"
