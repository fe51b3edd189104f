"""Where scored rows come from: DataFrames, sequences, files, standard input."""
