"""helixframe: sequence novelty detection on PySpark DataFrames."""

__version__ = "0.1.0"

from .functions.sequences import active_ks, kernel_weights, kmers, neighbourhood, weighted_neighbourhood
from .functions.statistics import aggregate_all, auc, auc_of_reads, register_aggregator
from .operators.density import oa_pairs
from .operators.features import combined_features, kmer_counts, weighted_features
from .operators.kernels import cross_gram, gram, normalise
from .operators.nystrom import NystromState
from .plans.pipelines import Kernel, evaluate, exact_scores, infer, low_rank_scores, train
from .sources.fasta import read_fasta
from .sources.model_store import load_model, save_model

__all__ = ["Kernel", "NystromState", "active_ks", "aggregate_all", "auc", "auc_of_reads", "combined_features", "cross_gram", "evaluate", "exact_scores", "gram", "infer", "kernel_weights", "kmer_counts", "kmers", "load_model", "low_rank_scores", "neighbourhood", "normalise", "oa_pairs", "read_fasta", "register_aggregator", "save_model", "train", "weighted_features", "weighted_neighbourhood"]
