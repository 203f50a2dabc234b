import pytest
from frames import datagram, rows_of, segment

from flowlark.operators import detectors as C
from flowlark.operators import evaluation as J
from flowlark.plans import pipeline
from flowlark.schemas import OBSERVATION


def test_many_cases_in_one_plan_equal_each_alone(spark):
    s = pipeline.DetectionSettings(C.Detector("packet", "p1"), C.VolumeDetector("volume", "v1", "packet_count", 1), C.ControlDetector("control", "c1", "forward_syn_count", 0), 5_000_000)
    rows = []
    for case in range(200):
        records = [(1_000_000 + 100 * k, segment(True, 2, seq=100, port=1000 + (case + k) % 3) if (case + k) % 2 else datagram(True, b"x", port=2000 + k % 2)) for k in range(1 + case % 5)]
        rows += rows_of(records, f"case{case}")
    observations = spark.createDataFrame(rows, OBSERVATION)
    found = pipeline.detect(observations, s)
    flow = J.finding_identities(found.flow_findings, packet=False, index="finding_index").where("actual_index % 3 <> 0").selectExpr("actual_index AS expectation_index", "IF(actual_index % 2 = 0, 'positive', 'negative') AS polarity", *J.FLOW_IDENTITY)
    packet = J.finding_identities(found.packet_findings, packet=True, index="finding_index").where("packet_index % 2 = 0").selectExpr("actual_index AS expectation_index", "'positive' AS polarity", "session", *J.PACKET_IDENTITY)
    flow, packet = spark.createDataFrame(flow.collect(), flow.schema), spark.createDataFrame(packet.collect(), packet.schema)
    only = flow.limit(1).selectExpr("* EXCEPT (session)", "'no packets' AS session").select(*flow.columns)
    got = {(r.case, r.channel): r.asDict() for r in pipeline.evaluate_cases(observations, s, packet, flow.unionByName(only)).collect()}
    assert len(got) == 2 * 201
    assert got["no packets", "flow"]["false_negatives"] + got["no packets", "flow"]["unclassified"] == 1
    for case in ("case3", "case124"):
        alone = pipeline.validate_end_to_end(observations.where(f"session = '{case}'"), s, packet.where(f"session = '{case}'").drop("session"), flow.where(f"session = '{case}'"))
        for r in alone.collect():
            assert {k: v for k, v in got[case, r.channel].items() if k != "case"} == r.asDict()
    with pytest.raises(ValueError, match="twice"):
        pipeline.evaluate_cases(observations, s, packet.unionByName(packet), flow)
