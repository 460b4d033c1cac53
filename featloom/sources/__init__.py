"""Reading and writing collections of tables."""

from featloom.sources.files import from_csv, from_csv_dir, from_parquet, read_known
from featloom.sources.memory import from_frames, into_dataset
from featloom.sources.saved import load_dataset, save_dataset

__all__ = [
    "from_csv",
    "from_csv_dir",
    "from_frames",
    "from_parquet",
    "into_dataset",
    "load_dataset",
    "read_known",
    "save_dataset",
]
