"""DataFrame operators: joins with stated tie rules, ranks, sampling, gates, resampling."""
