"""corpuslens: corpus analysis as Spark jobs.

Files are listed, filtered, cut into line chunks, sent through a cached model stage, rolled up,
linked in an import graph, stored as searchable collections and reported on. Every operator takes
and gives DataFrames; every table carries ``corpus_id``, so one job covers many corpora.
"""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Python stages travel to executors by value: the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from corpuslens.operators.chunks import chunk_fixed, chunk_significant, line_counts, lines  # noqa: E402
from corpuslens.operators.discovery import discover, ignore_files, remaining, resumable, vanished  # noqa: E402
from corpuslens.operators.graph import graph_lines, graph_nodes, import_edges  # noqa: E402
from corpuslens.operators.lookup import file_details, file_summary, list_files, project_info  # noqa: E402
from corpuslens.operators.model import add_prompts, infer, normalise_replies  # noqa: E402
from corpuslens.operators.report import file_report, report_index, write_lines  # noqa: E402
from corpuslens.operators.search import find_similar, knn, knn_cells, search, search_by_type  # noqa: E402
from corpuslens.plans.analyze import analyze_corpora, analyze_files  # noqa: E402
from corpuslens.sources.files import from_table, read_content, scan, walk  # noqa: E402
from corpuslens.sources.store import build_index, compact, read_collections, read_index, write_records  # noqa: E402
from corpuslens.streaming.incremental import all_of, analyze_stream, report_sink, store_sink  # noqa: E402

__version__ = "0.1.0"
