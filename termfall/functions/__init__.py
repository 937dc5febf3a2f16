"""Text analysis, stemming and scoring as column expressions."""
