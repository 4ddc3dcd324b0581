from decimal import Decimal as D

from hypothesis import given
from hypothesis import strategies as st

from barloom.operators import money
from barloom.operators.orders import Account, Bar, Commission, Order, Sizing

TRADES = "run_id string, symbol string, direction string, entry_ts long, entry_price double, exit_ts long, exit_price double, exit_reason string, stop double"


def one(**more):
    return {"direction": "long", "entry_price": "50000", "exit_price": "55000"} | more


def test_a_long_entry_digit_for_digit():
    """A stake of 1000 at 0.1 percent: a fee of 1, and 8999 left while the position is open."""
    (t,) = money.settled([one()], "10000", Sizing("fixed_dollar", fixed=1000), Commission("percentage", 0.1))
    assert str(t["qty"]) == "0.020000000000" and str(money.fee(D(1000), Commission("percentage", 0.1))) == "1.000000000000"
    assert str(D("10000.000000000000") - D(1000) - money.fee(D(1000), Commission("percentage", 0.1))) == "8999.000000000000"
    assert str(t["pnl"]) == "97.900000000000" and str(t["commission"]) == "2.100000000000" and str(t["cash"]) == "10097.900000000000"


def test_products_and_quotients_are_cut():
    assert str(money.over(D(1000), D(3))) == "333.333333333333" and str(money.over(D(-2), D(3))) == "-0.666666666666"
    assert str(money.times(D("0.333333333333"), D(3))) == "0.999999999999"
    assert str(money.stop_loss("100", 3)) == "97.000000" and str(money.take_profit("0.1234567", 7.5)) == "0.132715"
    assert str(money.stop_loss(33.333333, 1 / 3)) == str(money.times(D("33.333333"), D("0.996666"), 6))


def test_sizes_by_risk():
    assert money.risk_stake(D(10000), 1, D(100), D(95)) == D(2000)
    assert money.risk_stake(D(10000), 1, D(100), None) == D(2000)  # 5 % under the price
    assert money.risk_stake(D(10000), 50, D(100), D(95)) == D(10000)  # within the leverage


def test_fees():
    assert str(money.fee(D(1000), Commission("fixed", 2.5))) == "2.500000000000"
    assert str(money.fee(D(10), Commission("percentage", 0.1, 1.0))) == "1.000000000000"
    assert str(money.fee(D(10), Commission("per_unit", 0.25), D("3.5"))) == "0.875000000000"


def test_commissions_of_other_kinds():
    assert Commission("per_unit", 0.25).of(1000.0, 4.0) == 1.0 and Commission("per_unit", 0.25, 2.0).of(1000.0, 4.0) == 2.0
    tiered = Commission(lambda value, qty: value * (0.001 if value < 5000 else 0.0005))
    account = Account(10_000.0, tiered)
    account.waiting.append(Order("long", 6000.0))
    account.fill(Bar(0, 50.0, 51.0, 49.0, 50.0, 0))
    assert account.cash == 10_000 - 6000 - 3.0
    account.close(40.0, Bar(60, 40.0, 40.0, 40.0, 40.0, 1), "x")
    assert account.trades[0][7] == 3.0 + 4.8


@given(st.lists(st.tuples(st.sampled_from(["long", "short"]), st.integers(1, 10**7), st.integers(1, 10**7)), max_size=12), st.integers(1, 300))
def test_cash_is_capital_and_profits(rows, percent):
    """No unit is lost: cash is the capital with all profits, exactly."""
    trades = [one(direction=d, entry_price=D(a) / 100, exit_price=D(b) / 100) for d, a, b in rows]
    out = list(money.settled(trades, 10_000, Sizing(percent=percent / 10), Commission("percentage", 0.07, 0.01)))
    assert (out[-1]["cash"] if out else D(10_000)) == D(10_000) + sum(t["pnl"] for t in out)


def test_ledger_of_runs(spark):
    rows = [("r", s, d, i * 10, 100.0 + i, i * 10 + 5, 103.0 - i, "x", None) for s in "AB" for i, d in enumerate(["long", "short", "long"])]
    df = spark.createDataFrame(rows[::-1], TRADES)
    got = money.exact_ledger(df, commission=Commission("percentage", 0.1), sizing=Sizing(percent=10.0))
    assert dict(got.dtypes)["pnl"] == "decimal(38,12)"
    want = [t["cash"] for t in money.settled([dict(zip(TRADES.replace(" string", "").replace(" long", "").replace(" double", "").split(", "), r, strict=True)) for r in rows[:3]], 10_000.0, Sizing(percent=10.0), Commission("percentage", 0.1))]
    for s in "AB":
        assert [r.cash for r in got.where(f"symbol = '{s}'").orderBy("entry_ts").collect()] == want
    assert money.exact_ledger(df.where("false")).count() == 0


def test_exact_means(spark):
    df = spark.createDataFrame([(D("1.000000000000"),), (D("1.000000000001"),), (D("0.000000000001"),)], "x decimal(38,12)")
    assert df.agg(money.exact_mean("x").alias("m")).first().m == D("0.666666666667")  # 0.66666666666733...
    assert df.selectExpr("-x AS x").agg(money.exact_mean("x").alias("m")).first().m == D("-0.666666666667")
