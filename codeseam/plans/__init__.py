"""Query builders over fact tables and driver tables."""
