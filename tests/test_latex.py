"""LaTeX export and the command line."""

from sheaf.__main__ import main
from sheaf.sources.latex import latex


def test_latex():
    out = latex("* A & B\npara *bold* [[http://x/%20][d_e]]\n- [X] one\n- two\n| a | b |\n|---+---|\n| 1 | 2 |\n#+begin_src sql\nselect $1\n#+end_src\n** COMMENT gone\n")
    assert r"\section{A \& B}\label{a-b}" in out and r"\textbf{bold}" in out and r"\href{http://x/\%20}{d\_e}" in out
    assert "\\begin{itemize}\n\\item[$\\boxtimes$] one\n\\item two\n\\end{itemize}" in out and "a & b \\\\\n\\hline\n1 & 2 \\\\" in out
    assert "\\begin{verbatim}\nselect $1\n\\end{verbatim}" in out and "gone" not in out


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.org").write_text("#+LINK: x\n* TODO one\n")
    assert main(["lint", str(tmp_path), "--form", "compact"]) == 0
    assert "ORG005" in capsys.readouterr().out
    assert main(["sql", str(tmp_path), "select kind, count(*) as n from org_elements where kind = 'headline' group by kind"]) == 0
    assert '"n":1' in capsys.readouterr().out
    assert main(["headlines", str(tmp_path / "a.org"), "ONE"]) == 0
    assert "one" in capsys.readouterr().out
