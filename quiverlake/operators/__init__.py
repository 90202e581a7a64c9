"""Search, retrieval, compression, collections, routing, graphs and statistics over DataFrames."""
