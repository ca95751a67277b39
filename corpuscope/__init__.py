"""corpuscope: rule-based audit of large document collections on Spark."""

import sys

from pyspark import cloudpickle

from .operators.assemble import Elements, assemble_documents
from .plans.audit import Audit, analyze, extract_features
from .plans.reports import build_report
from .plans.runs import audit_folder, audit_manifest
from .rulepack import DEFAULT_PACK, RulePack

__all__ = [
    "Audit",
    "DEFAULT_PACK",
    "Elements",
    "RulePack",
    "analyze",
    "assemble_documents",
    "audit_folder",
    "audit_manifest",
    "build_report",
    "extract_features",
]

# The few functions that run in Python workers travel by value, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
