"""Part of the canopy package."""
