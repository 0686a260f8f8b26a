"""DataFrame operators: profile, quality, cleaning, statistics, modelling."""
