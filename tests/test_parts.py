"""What queries write on their way."""

from tessera.plans import modelling, registry

SF = "/root/testdata/sf0.001"


def test_leave_one_out_writes_the_parts_once(spark, monkeypatch):
    names, written = [], modelling.written
    monkeypatch.setattr(modelling, "written", lambda df, name: names.append(name) or written(df, name))
    rows = {r.name: r["drop"] for r in registry.QUERIES["fsel5_leave_one_out"](spark, SF).collect()}
    assert rows.keys() == set(modelling.BASE) and names.count("order-parts") == 1 == names.count("order-task")


def test_folds_of_prices_hold_what_the_models_read(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(modelling.L, "stack_regression", lambda pool, fit, test, row_id: seen.append(fit.columns) or test)
    assert registry.QUERIES["stk3_stacking_regression"](spark, SF).count() > 0 and seen == [["row_id", "y", "features"]]
