"""Made-up complaints with separable wording, for tests only."""

from itertools import product

PLACES = ["Hill Lane", "Mill Road", "the north market", "Lake View", "the old bridge"]
TOPICS = {
    "Roads Head": (["pothole", "asphalt", "kerb"], ["swallowed a wheel", "is crumbling"]),
    "Parks Head": (["bench", "playground", "hedge"], ["needs trimming", "was vandalised"]),
    "Lamps Head": (["lantern", "bulb", "lamppost"], ["flickers at night", "stays dark"]),
}
PRIORITIES = {"Roads Head": "High", "Parks Head": "Low", "Lamps Head": "Medium"}
DAYS = {"Roads Head": 1.0, "Parks Head": 5.0, "Lamps Head": 3.0}


def history():
    rows = []
    for officer, (things, faults) in TOPICS.items():
        for thing, fault, place in product(things, faults, PLACES):
            text = f"The {thing} near {place} {fault}, say residents."
            rows.append((text, officer, PRIORITIES[officer], DAYS[officer]))
    return rows


COLUMNS = ["complaint_text", "assigned_officer", "priority", "eta"]
