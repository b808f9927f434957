"""Commands against golden texts of our own."""

import io

import pytest

from colsmith.cli import main
from colsmith.golden import check, check_file, matches, parse
from colsmith.sources.spec import MARK

H = MARK + "\tone\ttwo\tthree\n"
BODY = "aaa\t1\tx\nbbb\t2\ty\nbbb\t3\tz\n"
IN = f"#stdin\n{H}{BODY}"

GOLDENS = [
    f"#command cut -f three,n:1 -e s:two*2 -c t:^{{one}}!\n{IN}#stdout\n{MARK}\tthree\tn\ts\tt\nx\taaa\t2\taaa!\ny\tbbb\t4\tbbb!\nz\tbbb\t6\tbbb!\n",
    f"#command cgrep -p one,exact,bbb -V $TMP/rest\n{IN}#stdout\n{H}bbb\t2\ty\nbbb\t3\tz\n#outfile rest\n{H}aaa\t1\tx\n",
    f"#command cat -n k,5,end\n{IN}#stdout\n{MARK}\tone\ttwo\tthree\tk\naaa\t1\tx\t5\nbbb\t2\ty\t6\nbbb\t3\tz\t7\n",
    f"#command sort -k two,float.rev\n{IN}#stdout\n{H}bbb\t3\tz\nbbb\t2\ty\naaa\t1\tx\n",
    "#command sort -c -k 1\n#stdin\nb\na\n#stdout\n#status 1\n",
    f"#command uniq -k one -c n,begin -a two,sum\n{IN}#stdout\n{MARK}\tn\tone\ttwo\tthree\n1\taaa\t1\tx\n2\tbbb\t5\ty\n",
    "#command uniq --hash\n#stdin\nb\na\nb\n#stdout\nb\na\n",
    "#command wc\n#stdin\na\n\nb\n#stdout\n3\n",
    "#command wc --agg n,asum,occurs,, -l\n#stdin\na,b\nc,,d\n#stdout\n2\t3\n",
    f"#command join -k one.1 $TMP/l $TMP/r -a 1,$TMP/only\n#infile l\n{H}{BODY}#infile r\nbbb\tQ\nccc\tR\n#stdout\n{H[:-1]}\tc2\nbbb\t2\ty\tQ\nbbb\t3\tz\tQ\n#outfile only\n{H}aaa\t1\tx\n",
    f"#command paste -e late -d - $TMP/l $TMP/r\n#infile l\n{H}{BODY}#infile r\n{MARK}\tfour\nq\n#stdout\n{H[:-1]}\tfour\naaa\t1\tx\tq\nbbb\t2\ty\t-\nbbb\t3\tz\t-\n",
    f"#command paste $TMP/l $TMP/r\n#infile l\n{MARK}\tp\na\nb\n#infile r\n{MARK}\tq\n1\n#stdout\n{MARK}\tp\tq\na\t1\n#stderr infix,rows\n#status 1\n",
    "#command sample -r 1,3\n#stdin\na\nb\nc\nd\n#stdout\na\nc\n",
    "#command sample -s 2\n#stdin\na\nb\nc\nd\n#stdout\na\nd\n",
    "#command transpose\n#stdin\na\tb\nc\td\n#stdout\na\tc\nb\td\n",
    f"#command binsearch -k one -C 1,0 -H f:1 bbb $TMP/l\n#infile l\n{H}{BODY}#stdout\n{MARK}\tf\tone\ttwo\tthree\nl\taaa\t1\tx\nl\tbbb\t2\ty\nl\tbbb\t3\tz\n",
    f"#command verify -p one,regex,b -p three,length,1\n{IN}#stderr infix,one,regex,b line 1\n#status 1\n",
    f"#command verify -p one,regex,[ab] --sort -k one\n{IN}#stdout\n",
    f"#command filegen -c grid -m 2,expr,line*col -h -n 2\n#stdout\n{MARK}\tc1\tc2\tc3\n1_1\t2\t3\n2_1\t4\t6\n",
    "#command calc 1+2 roman,4\n#stdout\n3\nIV\n",
    "#command help gen\n#stdout infix,permute\n",
    "#command cut -f nosuch <<a\n#stderr infix,nosuch\n#status 1\n",
]


@pytest.mark.parametrize("golden", GOLDENS, ids=lambda g: g.split("\n")[0][9:30])
def test_goldens(spark, golden):
    assert check(golden, spark) == []


def test_runner(spark, tmp_path):
    p = tmp_path / "t.test"
    p.write_text("#command wc\n# a comment\n#stdin\na\n#stdout\n2\n")
    assert len(check_file(str(p), spark)) == 1
    out = io.StringIO()
    assert main(["tooltest", str(p)], spark, [], out) == 1 and "stdout" in out.getvalue()
    assert main(["nothing"], spark, [], out) == 1
    assert parse("#stdin\na\n#nonewline\n#stdout\n")["stdin"] == "a" and matches("infix.not,x", "abc")
