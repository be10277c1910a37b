"""Change events of a position feed: several micro-batches, a restart, late rows and forgotten vehicles."""

import datetime

from aerodeck.operators.ordered import shared_folder
from aerodeck.streaming import feeds

T0 = datetime.datetime(2024, 1, 1)
ROWS = "vehicle long, event_id long, ts timestamp, icao string"


def _at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_micro_batches_restart_late_rows_and_gaps(spark, tmp_path):
    files = [
        [(1, 2, _at(2), "B"), (1, 1, _at(1), "A"), (2, 3, _at(1), None), (1, 4, _at(3), "B"), (None, 5, _at(1), "A")],  # out of order in a batch
        [(1, 6, _at(2), "C"), (1, 7, _at(4), None), (2, 8, _at(5), "D")],  # event 6 is earlier than what was taken
        [(1, 9, _at(5), None), (1, 10, _at(6), "A"), (2, 11, _at(6), "D"), (2, 11, _at(6), "D")],
        [(2, 12, _at(6 + 31 * 24 * 60), "D"), (1, 13, _at(7 + 31 * 24 * 60), None)],  # silent for more than 30 days
    ]
    work, source = f"{shared_folder(spark)}/test-changes-{tmp_path.name}-{id(files)}", str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)

    def run():
        feed = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        feeds.run_changes(feed, f"{work}/out", f"{work}/state")
        return {(r.vehicle, r.event_id, r.icao) for r in spark.read.schema(feeds.CHANGE).parquet(f"{work}/out").collect()}

    add(files[0])
    first = {(1, 1, "A"), (1, 2, "B")}
    assert run() == first
    add(files[1])
    second = first | {(1, 7, None), (2, 8, "D")}
    assert run() == second  # a new run goes on from the state of the last one
    assert run() == second  # and writes nothing twice
    add(files[2])
    add(files[3])
    assert run() == second | {(1, 10, "A"), (2, 12, "D")}
