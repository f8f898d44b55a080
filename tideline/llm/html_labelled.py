"""Labelled pages for the page extractor: our own small pages in the common
layouts of the web. Elements that bear ``data-x`` are boilerplate with all that
they hold; everything else is content."""

BOILERPLATE_MARK = "data-x"

PAGES = [
    # A local paper: many kinds of notices and adverts around and inside the text.
    """<html><head><title>River</title></head><body class="home"><div data-x class="consent" id="cookie"><p>We and our partners store cookies.</p><button>Agree</button></div>
    <div data-x class="notification">Download our app</div><div data-x class="masthead"><a href="/">The Valley Herald</a><span>Tuesday</span></div>
    <div data-x class="toolbar"><a>Print</a><a>Larger text</a></div><nav data-x class="navbar menu"><ul class="menu"><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>
    <ol data-x class="breadcrumb"><li><a>Home</a></li><li><a>News</a></li></ol>
    <article><h1>The river rises</h1><p><b>The river rose</b> by a metre on Sunday.<br>Nobody was hurt.</p>
    <div data-x class="adverts"><p>Carpets at half price</p></div><p>Volunteers filled <i>three thousand</i> bags with sand.</p><p>The mayor said:<br><q>We were ready.</q></p>
    <aside data-x class="promo"><h4>More from the valley</h4></aside><p>Rain is expected<br>until Friday.</p></article>
    <div data-x class="sharing"><a>Send to a friend</a></div><div data-x class="popular"><h3>Most read</h3><ol><li><a>Cows on the road</a></li></ol></div>
    <section data-x class="discussion" id="comments"><h3>What readers say</h3><div class="comment"><p>My cellar is full of water.</p></div></section>
    <div data-x class="signup newsletter"><label>Mail</label><input><button>Subscribe</button></div><footer data-x><p>All rights reserved</p></footer></body></html>""",
    # A recipe blog.
    """<html><body><div data-x role="banner"><a>Kitchen notes</a></div><div data-x class="search" role="search"><input><button>Find</button></div>
    <div class="content"><h1>Onion soup</h1><p>Slice the onions<br>and fry them slowly.</p><p>It takes an hour.</p><h2>You need</h2><ul><li>onions</li><li>butter</li><li>bread</li></ul>
    <h2>Steps</h2><ol><li>Melt the butter.</li><li>Add the onions.</li><li>Pour in the broth.</li></ol><p>Serve it <em>hot</em>.</p><p>Enjoy!</p></div>
    <div data-x class="advertising"><a>Pans and pots</a></div><div data-x class="sidebar"><div class="widget"><h3>About me</h3><p>I cook every day.</p></div><div class="widget">Tags</div></div>
    <div data-x class="follow"><a>On the photo site</a></div><div data-x class="replies"><p>Lovely soup!</p><p>I added thyme.</p></div>
    <div data-x class="related"><a>Leek soup</a><a>Bean soup</a></div><div data-x role="contentinfo" class="disclaimer">No liability for burnt onions</div></body></html>""",
    # A travel story in a page built of plain divisions.
    """<html><body><div id="wrap"><div data-x class="ad"><a>Fly now</a></div><div data-x class="alert">Our offices are closed today</div><div data-x id="navigation" class="navigation"><a>Europe</a> <a>Asia</a></div>
    <div class="text"><h2>Two days in the hills</h2><div>We walked from the station.</div><div>The path was steep.</div><blockquote>Take water with you, they said.</blockquote><p>At noon<br>we reached the hut.</p>
    <p data-x class="ad">Boots in all sizes</p><p data-x class="sponsored">Hotels near you</p><p>The view was wide.</p><p><strong>Day two</strong></p><p>It rained.</p></div>
    <div data-x class="share"><a>Mail</a></div><div data-x class="pagination"><a>1</a><a>2</a></div><div data-x class="recommended"><h3>Read next</h3><p>Three days at sea</p></div><div data-x class="teaser"><p>Win a tent</p></div>
    <div data-x class="comments"><p>We were there last year, and it rained as well.</p></div><div data-x class="login"><a>Sign in</a></div><div data-x class="copyright">The hill club</div></div>
    <div data-x class="overlay popup" role="dialog"><p>Do not miss our offers</p><button>No thanks</button></div></body></html>""",
    # A council's page about waste.
    """<html><body><header data-x><span class="logo">The council</span><form class="search"><input></form></header><div data-x class="cookies"><p>This site uses cookies.</p></div><div data-x role="navigation"><ul><li><a>Services</a></li></ul></div>
    <main><h1>Waste</h1><p>Bins are emptied on Mondays.</p><table><tr><th>Colour</th><th>Content</th></tr><tr><td>blue</td><td>paper</td></tr><tr><td>green</td><td>garden waste</td></tr></table>
    <h3>Dates</h3><p>There is no service<br>on holidays.</p><p>Put the bin out by six.</p><dl><dt>Lost bins</dt><dd>Ask for a new one.</dd></dl><p>Thank you.</p></main>
    <div data-x role="complementary"><h2>Contact</h2><p>Call us.</p></div><form data-x role="form" class="form"><label>Was this helpful?</label><input><button>Yes</button></form>
    <div data-x role="alert" class="notice">Strike on Tuesday</div><footer data-x role="contentinfo"><ul><li><a>Privacy</a></li><li><a>Imprint</a></li></ul></footer></body></html>""",
    # A review with reader comments, and another page that carries several adverts.
    """<html><body><div data-x class="menu" role="menubar"><a>Films</a></div><div data-x class="banner advertisement"><a>Popcorn</a></div><div class="main"><h1>A quiet film</h1><h2>No words at all</h2><p>It has no dialogue.</p><p>That is its strength.</p>
    <div data-x class="advertisement"><a>Tickets</a></div><p>The pictures<br>speak.</p><ul><li>Length: two hours</li><li>Age: all</li></ul><p>Go and see it.</p></div><div data-x class="ads"><a>Sweets</a></div>
    <div data-x id="comments" class="comments"><div class="comment"><b>Ann</b><p>I fell asleep.</p></div><div class="comment"><b>Bo</b><p>I loved it very much and saw it twice.</p></div></div>
    <div data-x class="subscribe modal"><p>Our letter comes on Fridays</p></div><div data-x class="social"><a>Share it</a></div><div data-x id="footer" class="footer">Film club</div></body></html>""",
    # A help page of an application, and a forum's answer.
    """<html><body><div data-x class="navbar"><a>Account</a></div><div data-x role="toolbar"><button>Bold</button></div><div data-x role="menu"><a>File</a><a>Edit</a></div><div data-x role="alertdialog"><p>Unsaved changes</p></div>
    <div class="help"><h1>Saving your work</h1><p>Press the button<br>or wait a minute.</p><pre>Ctrl S</pre><p>Copies are kept for a week.</p></div><div data-x class="widget">Chat with us</div><div data-x role="form"><label>Tell us more</label><input></div>
    <div data-x class="discussion"><p>It does not work on my phone.</p></div><div data-x class="advert"><p>Paper and ink</p></div></body></html>""",
    """<html><body><div data-x class="navbar"><a>Forum</a><a>Rules</a></div><div class="answer"><h2>Why is the sky blue?</h2><p>Air scatters blue light more than red light.</p><ul><li>At noon it is blue.</li><li>In the evening it is red.</li></ul></div>
    <div data-x class="widget"><h3>New questions</h3><a>Why is grass green?</a></div><p data-x class="advert">Telescopes</p><div data-x class="discussion">Join in</div><p data-x class="disclaimer">Answers may be wrong</p><p data-x class="alert">Maintenance tonight</p></body></html>""",
    # A news article with the usual surroundings.
    """<html><body><header data-x class="site-header"><div class="logo">The Paper</div></header>
    <nav data-x class="main-nav"><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></nav>
    <div data-x class="breadcrumbs"><a>Home</a> <a>World</a></div>
    <main><article class="post"><h1 class="entry-title">A bridge is opened</h1><p class="lead">The new bridge was opened on Monday.</p>
    <p>It took <b>four years</b> and a great deal of <a href="/steel">steel</a> to build it.</p>
    <div data-x class="ad">Buy a car today</div><div data-x class="advert banner">Cheap flights</div>
    <p>Traffic crossed it in the first hour.</p><h2>Costs</h2><p>The costs were higher than planned.</p>
    <div data-x class="share-buttons social"><a>Tweet</a><a>Post</a></div></article></main>
    <aside data-x class="sidebar"><h3>Most read</h3><ul><li><a>One</a></li><li><a>Two</a></li></ul></aside>
    <footer data-x class="site-footer">Copyright The Paper</footer></body></html>""",
    # A blog without semantic elements.
    """<html><body><div class="wrapper container" id="page"><div data-x id="header"><a>My blog</a></div><div data-x id="menu" class="menu"><a>About</a></div>
    <div class="content" id="content"><div class="post hentry"><h2 class="post-title">On bread</h2><div class="post-body entry-content"><p>Flour, water and time are enough.</p>
    <p>Knead it for ten minutes.</p><ul><li>500 g of flour</li><li>350 g of water</li></ul><blockquote>Bread is life.</blockquote><p>Bake it hot.</p></div>
    <div data-x class="related-posts related"><a>On butter</a></div></div>
    <div data-x id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p>Great text, thank you</p></div></div>
    <form data-x class="comment-form"><label>Name</label><input><textarea></textarea></form></div>
    <div data-x id="sidebar" class="sidebar widget-area"><div class="widget">Archive</div></div><div data-x id="footer" class="footer">Powered by us</div></div></body></html>""",
    # Notices and dialogs.
    """<html><body><div data-x class="cookie-notice consent">We use cookies</div><div data-x class="cookie-banner">Accept</div><div data-x role="alert" class="alert notice">Please update your browser</div>
    <div data-x class="gdpr privacy-notice">Your privacy</div><div data-x class="modal popup overlay" role="dialog">Join our list</div><div data-x class="newsletter-signup newsletter subscribe">Subscribe now</div>
    <section class="article-body text"><h1>Rivers</h1><p>Rivers carry water to the sea.</p><p>Some are dry in summer.</p><figure class="image"><img src="a"><figcaption class="caption">A dry river</figcaption></figure>
    <p>The longest one is here.</p></section><div data-x class="paywall">Log in to read</div><div data-x class="login">Sign in</div><p data-x class="notice">Cookies are used</p><p data-x class="advertisement">Advertisement</p><section data-x class="promo promotion">Offers</section></body></html>""",
    # A reference page with tables, lists and code.
    """<html><body><div data-x role="banner">Docs</div><div data-x role="navigation" class="navbar navigation toc">Contents</div><div role="main" class="document body"><div class="section"><h1>Sorting</h1>
    <p>The function sorts a list.</p><pre><code>sort(x)</code></pre><table class="table"><thead><tr><th>Name</th><th>Use</th></tr></thead><tbody><tr><td>key</td><td>what to sort by</td></tr></tbody></table>
    <dl><dt>stable</dt><dd>equal items keep their order</dd></dl><ol><li>First it looks at the list.</li><li>Then it sorts.</li></ol><h3>Notes</h3><p>It is fast.</p></div></div>
    <form data-x role="search" class="search search-form"><input><button>Go</button></form><div data-x role="complementary">See also</div><div data-x role="contentinfo">Version 3</div>
    <div data-x class="pagination pager"><a>Next</a></div></body></html>""",
    # A magazine with adverts and teasers between the paragraphs.
    """<html><body><div data-x class="top-bar header">Magazine</div><article><h1>The fox</h1><p>The fox came at night.</p><aside data-x class="teaser">Also read</aside><p>It took two hens.</p>
    <div data-x class="ads">Ads</div><div data-x id="ad-slot">Slot</div><ins data-x class="adsbygoogle">Ad</ins><div data-x class="sponsored sponsor">Partner</div><div data-x class="outbrain recommended recommendations">More for you</div><section class="chapter"><h2>Day two</h2><p>It came back. <em>Again</em> <span>and again</span>.</p></section>
    <section data-x class="reader-comments"><article class="comment"><p>Poor hens</p></article></section><ul data-x class="tags"><li>fox</li></ul><footer data-x>Written by A. Writer</footer></article>
    <div data-x class="popular trending">Trending</div><div data-x class="social-media follow">Follow us</div><div data-x class="disqus" id="disqus_thread">Comments</div></body></html>""",
    # A shop's guide and a forum's first post.
    """<html><body><header data-x>Shop</header><nav data-x id="nav" class="nav dropdown">Shoes</nav><div class="layout row"><div class="col column main-content"><h1 class="title headline">How to choose shoes</h1><div class="story"><p>Measure your foot.</p>
    <p>Choose a size up.</p><details><summary>Widths</summary><p>There are five widths.</p></details></div></div><div data-x class="side-bar rail right-rail">Offers</div></div><div data-x class="basket cart">Cart</div><div data-x class="legal copyright disclaimer">Legal</div><div data-x class="skip-link skiplink">Skip to content</div>
    <div data-x class="comment-list responses replies">Replies</div><div data-x class="feedback survey form">Rate us</div><form data-x><fieldset><legend>Contact</legend></fieldset></form><button data-x>Top</button></body></html>""",
    """<html><body class="single"><table class="layout"><tr><td data-x class="leftnav sidenav navigation">Links</td><td class="maintext text"><h1>Old page</h1><p>Tables made pages once.</p><center><p>It worked.</p></center></td><td data-x class="advertising adbox">Ad</td></tr></table>
    <div data-x class="footer bottom">Bottom</div><div data-x class="banner">Sale</div><div data-x class="comment">Nice page</div><nav data-x>Up</nav><aside data-x>Aside</aside><div data-x class="cookies">Cookies</div><div data-x class="notification message-bar">New version</div></body></html>""",
    """<html class="no-js"><body class="page has-sidebar"><div class="layout has-sidebar with-ads"><div class="page-wrapper clearfix"><div class="article-header"><h1>Seven days</h1></div><div class="article-text body-text"><p>The week has seven days.</p></div></div></div>
    <div data-x class="comments-area">Comments</div><p data-x class="ad">Ad</p><p data-x class="ads">Ads</p><div data-x class="ad-container">Ad</div><div data-x class="sidebar-content">Side</div><div data-x class="page-footer">Foot</div><div data-x class="page-header">Head</div><div data-x class="comment-content">Hm</div>
    <div data-x class="post-comments">Hm</div><section data-x class="related-content">Rel</section><ul data-x class="menu nav-list">Menu</ul><div data-x class="article-ad">Ad</div><div data-x class="post-share">Share</div><div data-x class="newsletter-form">News</div></body></html>""",
    # Plain pages: nothing but content.
    """<html><body><h1>Plain</h1><p>Nothing but text is here.</p><div><p>Even in a <i>div</i>.</p></div><hr><p>The <strong>end</strong>.</p></body></html>""",
    """<html><body><div id="article" class="article content"><h1>One</h1><h2>Two</h2><h3>Three</h3><h4>Four</h4><h5>Five</h5><h6>Six</h6><p>Seven <a>eight</a> <u>nine</u> <small>ten</small> <sup>1</sup> <q>q</q> <cite>c</cite></p><address>Here</address></div></body></html>""",
]
