"""DataFrame operators: cleaning, statistics, encoders, sequences, scores."""
