"""DataFrame operators: cleansing, baselines, profiles, detectors, similarity, matching."""
