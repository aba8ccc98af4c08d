"""Validators: DTD, XSD, RELAX NG and Schematron."""
