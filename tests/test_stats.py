from stockfair import schemas
from stockfair.operators import stats

F3 = [("Q1", "2024-01-15", "Evento Test 1", "Lazio", 1000.0, 300.0, 50.0, 20.0, 10.0),
      ("Q2", "2024-04-20", "Evento Test 2", "Lombardia", 1500.0, 400.0, 70.0, 30.0, 15.0),
      ("Q3", "2024-07-10", "Evento Test 3", "Lazio", 800.0, 200.0, 30.0, 10.0, 5.0)]


def _events(spark):
    cols = ["periodo", "data", "nome", "regione", "incassi", "costi_reali", "caschi", "occhiali",
            "pneumatici"]
    rows = [(i + 1, *r) for i, r in enumerate(F3)]
    df = spark.createDataFrame(rows, ["id"] + cols)
    return schemas.conform(df, "annual_events")


def test_f3_year(spark):
    a = _events(spark)
    s = stats.annual_summary(a, 2024).collect()[0]
    assert (s.total_incassi, s.total_costi, s.net_profit) == (3300.0, 900.0, 2400.0)
    assert (s.caschi, s.occhiali, s.pneumatici) == (150.0, 60.0, 30.0)
    regions = {r.regione: r.n_events for r in stats.events_per_region(a, 2024).collect()}
    assert regions == {"Lazio": 2, "Lombardia": 1}
    top = [r.nome for r in stats.top_events(a, 2024).collect()]
    assert top == ["Evento Test 2", "Evento Test 1", "Evento Test 3"]


def test_other_year_is_zero(spark):
    a = _events(spark)
    assert stats.income_by_year(a, 2023).collect()[0].total_incassi == 0.0
    assert stats.cost_by_year(a, 2023).collect()[0].total_costi == 0.0
    assert stats.top_events(a, 2023).count() == 0
    assert stats.events_per_region(a, 2023).count() == 0
