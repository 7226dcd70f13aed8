"""A folder settled as files come in is the folder settled at once."""

from ledgerlens.operators import profiles
from ledgerlens.plans import incremental, loading
from ledgerlens.sources import statements

ACCOUNTS = "account_id string, identifiers array<string>, statement_expected boolean, opened_on date, closed_on date, anchor bigint, prior_closing bigint"
FIGURES = {"opening": r"Opening,(?P<value>[^\n]*)", "closing": r"Closing,(?P<value>[^\n]*)", "account_id": r"Account,(?P<value>[^\n]*)", "period_from": r"Period,(?P<value>[^,\n]*)", "period_to": r"Period,[^,\n]*,(?P<value>[^\n]*)"}


def sheet(account, opening, rows, period):
    balance, lines = opening, []
    for day, amount in rows:
        balance += amount
        lines.append(f"{day},x,{amount}.00,{balance}.00")
    return "\n".join([f"Account,{account}", f"Opening,{opening}.00", f"Closing,{balance}.00", f"Period,{period[0]},{period[1]}", "Date,What,Amount,Balance", *lines]) + "\n"


def test_two_batches_are_one_run(spark, tmp_path):
    first, second = ("1/7/2025", "31/12/2025"), ("1/1/2026", "30/6/2026")
    waves = [
        {"b.csv": sheet("PK11", 105, [("2/2/2026", 3)], second), "c.csv": sheet("PK22", 10, [("1/8/2025", 1)], first), "z.csv": "just,text\n"},
        {"a.csv": sheet("PK11", 100, [("1/8/2025", 5)], first), "d.csv": sheet("PK11", 105, [("2/2/2026", 3)], second), "e.csv": sheet("PK33", 7, [("1/8/2025", 1)], first)},
        {"f.csv": sheet("PK22", 12, [("1/2/2026", 1)], second)},
    ]
    df = spark.createDataFrame
    table = df([profiles.profile("bank.v1", "csv", ["Date", "Amount"], {"date": "Date", "description": "What", "amount": "Amount", "balance": "Balance"}, ["d/M/yyyy"], "signed", patterns=FIGURES)], profiles.PROFILE)
    accounts = df([(k, [i], True, None, None, None, None) for k, i in (("a", "PK11"), ("b", "PK22"), ("c", "PK33"))], ACCOUNTS)
    (tmp_path / "in").mkdir()
    folder = incremental.Folder(str(tmp_path / "in"), str(tmp_path / "store"), table, accounts, "2025-07-01", "2026-06-30")
    for wave in waves:
        for name, content in wave.items():
            (tmp_path / "in" / name).write_text(content)
        incremental.watch(folder, str(tmp_path / "seen")).awaitTermination()
    # a batch that is run again counts once
    last = spark.read.format("binaryFile").load(str(tmp_path / "in" / "f.csv"))
    incremental.settle(folder, last, 2)

    files = statements.files(spark, folder.incoming)
    run = loading.load_files(files, statements.csv_rows(files), table, accounts, folder.start, folder.end)
    rows = lambda t: sorted(map(str, (r.asDict() for r in t.select(sorted(t.columns)).collect())))
    assert rows(incremental.now(folder, "ledgers")) == rows(run.ledgers)
    assert rows(incremental.now(folder, "checks")) == rows(run.checks)
    assert {r["account_id"]: r["account_status"] for r in run.ledgers.collect()} == {"a": "complete", "b": "failed", "c": "incomplete"}
    told = spark.read.parquet(folder.table("outcomes"))
    assert sorted((r["name"], r["outcome"]) for r in told.collect()) == [("a.csv", "ok"), ("b.csv", "ok"), ("c.csv", "ok"), ("d.csv", "duplicate"), ("e.csv", "ok"), ("f.csv", "ok"), ("z.csv", "unknown_layout")]
    # accounts that a batch does not touch are not settled again
    assert {r["account_id"] for r in spark.read.parquet(folder.table("ledgers")).filter("batch = 2").collect()} == {"b"}
