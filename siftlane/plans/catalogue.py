"""All named queries outside the subpackage for training data."""

from siftlane.plans import data_quality, reference

QUERIES = {**reference.QUERIES, **data_quality.QUERIES}
SQL = {**reference.SQL, **data_quality.SQL}
