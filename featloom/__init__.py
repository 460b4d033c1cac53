"""Automated feature engineering over collections of tables, as Spark plans."""

from featloom.operators import *  # noqa: F403
from featloom.plans.clean import clean, preview
from featloom.plans.profile import profile, profile_frame, table
from featloom.problem import Problem, suggest_problem
from featloom.schema import Attribute, Column, Dataset, Table
from featloom.sources import (
    from_csv,
    from_csv_dir,
    from_frames,
    from_parquet,
    into_dataset,
    load_dataset,
    read_known,
    save_dataset,
)

__version__ = "0.1.0"
