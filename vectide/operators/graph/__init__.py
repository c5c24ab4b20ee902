"""Proximity graphs: kernels, sharded builders and search, repair, neighbour descent."""
