"""Small source tables with every awkward case: null waste, zero input, several sample lines on one
batch, assessments without a batch, a pest under two rules, a null grade, a one-day season, a rule
without a requirement row."""

import datetime as dt
from decimal import Decimal as D

SITE, OTHER_SITE = "North shed", "South shed"


def day(text):
    return dt.date.fromisoformat(text)


def at(text):
    return dt.datetime.fromisoformat(text)


def delivery(i, season, date, bins, presize=False, pick=1, store=3, block=1, juice=None, output=None, kgs=None):
    return (i, f"D{i}", season, 1, block, 1, pick, store, 11, day(date), bins, presize, juice, output, kgs)


def batch(i, season, harvest, pack, kgs, waste, closed=True, packer=12, presize=False, block=1, sub=1):
    return (
        i, f"B{i}", season, 1, block, sub, 1, 1, 3, packer, 14, day(harvest), day(pack),
        None if kgs is None else D(kgs), None if waste is None else D(waste),
        at("2024-06-01T08:00:00") if closed else None, presize,
    )


ROWS = {
    "sw_SeasonT": [(1, "2024"), (2, "2025"), (3, "trial")],
    "sw_CompanyT": [(11, "Cool store"), (12, SITE), (13, OTHER_SITE), (14, "Batch grower"), (15, "Farm grower")],
    "sw_FarmT": [(1, "F1", "First farm", 15)],
    "sw_Farm_BlockT": [(1, "M1", 1), (2, "M2", 2)],
    "sw_SubdivisionT": [(1, "S1"), (2, "S2")],
    "sw_MaturityT": [(1, "MC")],
    "sw_Pick_NoT": [(1, "Pick 1", 1), (2, "Pick 2", 2)],
    "sw_Storage_TypeT": [(3, "RA store"), (4, "CA store"), (6, "Untreated")],
    "sw_ProductT": [(1, D("2.5"), True), (2, D("1.0"), True), (3, D("9.0"), False)],
    "ma_Bin_DeliveryT": [
        delivery(1, 1, "2024-02-15", 10), delivery(2, 1, "2024-02-16", 20, pick=2, store=4),
        delivery(3, 1, "2024-04-21", 40), delivery(4, 1, "2024-02-17", 7, presize=True),
        delivery(5, 2, "2025-02-10", 30, store=6), delivery(6, 2, "2025-02-12", 50, block=2),
        delivery(7, 2, "2025-04-20", 5), delivery(8, 3, "2025-03-01", 1),
        delivery(9, 1, "2024-03-01", 3, presize=True, juice=278, output=1, kgs=D("4")),
        delivery(10, 1, "2024-03-01", 3, presize=True, juice=278, output=1, kgs=D("6")),
        delivery(11, 1, "2024-03-01", 3, presize=True, juice=300, output=1, kgs=D("99")),
    ],
    "ma_BinT": [(1, 1, 1), (2, 1, 1), (3, 1, None), (4, 2, 1), (5, 2, 2), (6, 5, 6), (7, 5, 6)],
    "ma_Bin_UsageT": [(1, 1, 4), (1, 1, 6), (1, 9, 5), (2, None, 100), (2, 2, None)],
    "ma_Grader_BatchT": [
        batch(1, 1, "2024-02-15", "2024-03-01", "1000", "100"),
        batch(2, 1, "2024-02-16", "2024-03-11", "500", "50"),
        batch(3, 1, "2024-02-01", "2024-02-20", "400", None),          # waste unknown
        batch(4, 1, "2024-02-02", "2024-02-21", "0", "0"),             # 0/0
        batch(5, 1, "2024-02-20", "2024-04-20", "0", "30"),            # reject without input, on the close day
        batch(6, 2, "2025-02-10", "2025-03-02", "2000", "300"),
        batch(7, 2, "2025-02-12", "2025-03-20", "800", "80", packer=13),
        batch(8, 2, "2025-02-12", "2025-03-22", "600", "90", presize=True),
        batch(9, 2, "2025-02-14", "2025-04-20", "700", "70", closed=False, block=2),
        batch(10, 2, "2025-02-14", "2025-04-02", "700", "140", block=2),
    ],
    "ma_Pallet_DetailT": [(1, 1, 4), (1, 2, 5), (1, 3, 100), (2, 1, 2)],
    "ma_Grader_Batch_MPI_LotT": [(100, 1, "L100"), (101, 1, "L101"), (102, 6, "L102"), (103, 9, "L103")],
    "ma_Grader_Batch_MPI_Lot_PIP_RequirementT": [(1, 100, 1), (2, 101, 2), (3, 102, 1), (4, 102, 4)],
    "ma_CartonT": [("C1", 1, 100, True), ("C2", 1, 100, True), ("C3", 1, 100, False), ("C4", 2, None, True)],
    "ma_TransferT": [(1, 11, 12, day("2024-03-01")), (2, 12, 13, day("2024-03-02"))],
    "ma_Transfer_BinT": [(1, 1), (2, 1), (1, 3)],
    "qa_TemplateT": [(10, "Pests"), (13, "Defects A"), (14, "Defects B"), (28, "Defects C")],
    "qa_DefectT": [
        (1, "Bruise", None), (2, "Russet", None), (3, "Scale", "SCA"), (4, "Mealybug", "LLT"), (5, "Mite", "MIT"),
        (6, "Rot", "ROT"),
    ],
    "qa_AssessmentT": [
        (1, 1, None, 1, 13, 1, 1, 1, 100, at("2024-03-01T07:00:00")),
        (2, 1, None, 1, 14, 1, 1, 1, None, at("2024-03-02T07:00:00")),
        (3, None, None, 1, 28, 1, 1, 1, 50, at("2024-03-02T07:00:00")),
        (4, 6, None, 5, 13, 2, 1, 1, 200, at("2025-03-02T07:00:00")),
        (5, 6, None, 5, 13, 2, 1, 1, 400, at("2025-04-20T07:00:00")),
        (6, 1, 100, 1, 10, 1, 1, 1, 600, at("2024-03-01T09:00:00")),
        (7, 6, 102, 5, 10, 2, 1, 1, 600, at("2025-04-20T23:00:00")),
        (8, 1, 101, 1, 10, 1, 1, 1, 600, at("2024-04-21T09:00:00")),
    ],
    "qa_Assessment_DefectT": [
        (1, 1, 1, 10), (2, 1, 2, 5), (3, 2, 1, 4), (4, 3, 1, 9), (5, 4, 1, 20), (6, 4, 2, 40), (7, 5, 2, None),
        (8, 6, 3, 2), (9, 6, 4, 1), (10, 7, 3, 7), (11, 8, 3, 3), (12, 6, 1, 8), (13, 7, 6, 1),
    ],
    "pip_Market_RequirementT": [(1, "CHN"), (1, "TWN"), (2, "TWN"), (3, "CHN"), (4, "USA"), (5, "CHN")],
    "pip_RequirementT": [(1, "Free from scale", "G"), (2, "Free from all", "G"), (4, "Other", "H")],
    "pip_Requirement_PestT": [
        (1, "SCA", D("0"), D("0")), (2, "SCA", D("0"), D("0")), (2, "LLT", D("0"), D("0")),
        (3, "MIT", D("0"), D("0")), (4, "ROT", D("0"), D("0")), (5, "ROT", D("1"), D("1")),
    ],
    "STG_COMPAC_BATCH": [
        (at("2024-01-01T00:00:00"), 1, "G", "g", "53/2", "Class 1", 55.0, 60.0, 90.0, 95.0),   # not after midnight
        (at("2024-04-20T00:00:00"), 1, "G", "g", "53/2", "Class 1", 50.0, 60.0, 80.0, 85.0),   # at the bound
        (at("2024-04-20T00:00:01"), 1, "G", "g", "53/2", "Class 1", 50.0, 60.0, 80.0, 85.0),   # just past it
        (at("2024-03-01T10:00:00"), 1, "G", "g", "63/3", "Class 1", 60.0, 66.0, 100.0, 105.0),
        (at("2024-03-01T10:00:00"), 1, "G", "g", "99/9", "Class 1", 60.0, 66.0, 100.0, 105.0),
        (at("2024-03-01T10:00:00"), 2, "G", "g", "63/3", None, 60.0, 66.0, 100.0, 105.0),      # grade unknown
        (at("2024-03-01T10:00:00"), 2, "G", "g", "63/3", "Juice", 60.0, 66.0, 100.0, 105.0),
        (at("2024-03-01T10:00:00"), 2, "G", "g", "Rejects", "Class 1", 60.0, 66.0, 100.0, 105.0),
        (at("2024-03-01T10:00:00"), 2, "G", "g", "63/3", "Class 1", 30.0, 66.0, 100.0, 105.0),  # too small
        (at("2024-05-01T10:00:00"), 2, "G", "g", "67/4", "Class 1", 62.0, 66.0, 100.0, 105.0),
        (at("2025-02-01T10:00:00"), 3, "G", "g", "58/5", "Class 1", 58.0, 64.0, 95.0, 99.0),
        (at("2020-02-01T10:00:00"), 4, "G", "g", "58/5", "Class 1", 58.0, 64.0, 95.0, 99.0),
    ],
}
