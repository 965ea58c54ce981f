"""Query plans: staging views, operators and checks wired together."""

import importlib

MODULES = ["timebase", "scoring", "timed_joins", "course_units", "texts", "segmentation", "vectorial", "deliveries", "captionscores", "live"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"cuewise.plans.{name}")
