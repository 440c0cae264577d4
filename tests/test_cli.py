"""The command line accepts the original converters' flags."""

import pytest

from specweave.plans.cli import build_parser


def test_hcir_flags():
    a = build_parser().parse_args(["hcir", "--source-view", "v", "--output-dir", "o", "--batch-rows", "4096",
                                   "--expected-ir-length", "400"])
    assert (a.source_view, a.output_dir, a.expected_ir_length, a.max_molecules) == ("v", "o", 400, 0)


def test_msms_flags():
    a = build_parser().parse_args(["msms", "--source-view", "v", "--output-dir", "o", "--molecule-ref", "r",
                                   "--batch-molecules", "4096", "--expected-train-molecules", "4981273"])
    assert a.expected_train_molecules == 4981273 and a.expected_test_molecules == 0


def test_limits_raise_each_converter_s_text():
    from specweave.plans.cli import main

    with pytest.raises(ValueError, match="^batch rows must be positive and max molecules non-negative$"):
        main(["hcir", "--source-view", "v", "--output-dir", "o", "--batch-rows", "0"])
    with pytest.raises(ValueError, match="^batch and molecule limits must be non-negative$"):
        main(["msms", "--source-view", "v", "--output-dir", "o", "--molecule-ref", "r", "--max-molecules", "-1"])
