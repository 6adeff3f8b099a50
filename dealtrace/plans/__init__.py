"""The analyses: cleaning, integration, reports, attribution, scoring, checks."""
